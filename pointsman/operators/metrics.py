"""Routing quality metrics.

All systems, seeds and folds sit in one prediction table; `keys` names the columns that
tell them apart, and every metric is one aggregation per (keys, dataset) plus one over the
datasets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointsman.functions import numeric
from pointsman.operators.routing import first_best, name_at

#: Errors of predictions that cannot be compared.
INCOMPLETE = "a predicted sample lacks the score of some candidate"
UNEQUAL = "runs that should cover the same samples do not"

METRICS = ("AvgAcc", "GainR", "GainB", "GapO", "BestSingleAvg", "DatasetOracleAvg", "OracleAvg")


def _slot_means(column: str, n: int) -> list[Column]:
    return [F.avg(F.col(column)[i]).alias(f"_m{i}") for i in range(n)]


def _slots(n: int) -> Column:
    return F.array(*[F.col(f"_m{i}") for i in range(n)])


def attach_dataset(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Predictions with their dataset; fails while running on an unknown sample."""
    meta = samples.select("sample_id", "dataset")
    missing = F.raise_error(F.concat(F.lit("no sample for prediction "), F.col("sample_id")))
    return predictions.join(meta, "sample_id", "left").withColumn(
        "dataset", F.when(F.col("dataset").isNull(), missing).otherwise(F.col("dataset"))
    )


def macro_accuracy(rows: DataFrame, value: str = "selected_score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over datasets of the dataset mean."""
    per_dataset = rows.groupBy(*keys, "dataset").agg(F.avg(value).alias("_mean"))
    return per_dataset.groupBy(*keys).agg(F.avg("_mean").alias("AvgAcc"))


def best_single_train(train: DataFrame, models: list[str]) -> DataFrame:
    """One row: the candidate of the best micro mean, first name on ties."""
    means = train.agg(*_slot_means("score", len(models)))
    return means.select(
        name_at(models, first_best(_slots(len(models)))).alias("best_single_model"),
        F.array_max(_slots(len(models))).alias("mean_score"),
    )


def dataset_model_means(frame: DataFrame, models: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Per dataset: mean score array over candidates and mean best score."""
    return frame.groupBy(*keys, "dataset").agg(
        *_slot_means("score", len(models)), F.avg(F.array_max("score")).alias("oracle"), F.count("*").alias("n")
    ).select(*keys, "dataset", _slots(len(models)).alias("means"), "oracle", "n")


def best_single_macro(per_dataset: DataFrame, models: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """The candidate of the best mean of dataset means, chosen with hindsight."""
    macro = per_dataset.groupBy(*keys).agg(*_slot_means("means", len(models)))
    slots = _slots(len(models))
    return macro.select(
        *keys,
        first_best(slots).alias("best_slot"),
        name_at(models, first_best(slots)).alias("best_single_model"),
        F.array_max(slots).alias("best_single_avg"),
    )


def routing_metrics(picks: DataFrame, models: list[str], best_single: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nine micro metrics. `picks` has selected_score and the score array; `best_single` names the fixed candidate."""
    slot = F.array_position(F.array(*[F.lit(m) for m in models]), best_single).cast("int")
    row_mean = numeric.total(F.col("score")) / F.lit(float(len(models)))
    m = picks.groupBy(*keys).agg(
        F.avg("selected_score").alias("avg_score"),
        F.avg(row_mean).alias("random_score"),
        F.avg(F.element_at("score", slot)).alias("best_single_score"),
        F.avg(F.array_max("score")).alias("oracle_score"),
        F.count("*").alias("n_test"),
    )
    gap = F.col("oracle_score") - F.col("avg_score")
    room = F.col("oracle_score") - F.col("best_single_score")
    return m.select(
        *keys,
        "avg_score",
        "random_score",
        "best_single_score",
        "oracle_score",
        (F.col("avg_score") - F.col("random_score")).alias("gain_over_random"),
        (F.col("avg_score") - F.col("best_single_score")).alias("gain_over_best_single"),
        gap.alias("gap_to_oracle"),
        F.when(room > numeric.TINY, gap / room).alias("normalized_oracle_gap"),
        gap.alias("mean_regret"),
        "n_test",
    )


def benchmark_metrics(
    frame: DataFrame, predictions: DataFrame, models: list[str], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Headline metrics, as percentages, one row per combination of `keys`.

    `frame` has sample_id, dataset and the score array; `predictions` the keys, sample_id
    and selected_score. A prediction without a complete score array, or a second one of a
    sample, fails the job.
    """
    n = len(models)
    # Dealt by sample once: the check for doubles and the join then need no shuffle of their own.
    once = predictions.repartition("sample_id").groupBy(*keys, "sample_id").agg(
        F.max("selected_score").alias("selected_score"), F.count("*").alias("_n")
    )
    single = F.when(F.col("_n") == 1, F.col("selected_score")).otherwise(
        F.raise_error(F.concat(F.lit("two predictions of a sample: "), F.col("sample_id"))).cast("double")
    )
    rows = once.select(*keys, "sample_id", single.alias("selected_score")).join(
        frame.select("sample_id", "dataset", "score"), "sample_id", "left"
    )
    whole = F.count_if(F.col("score").isNull() | (F.size(F.filter("score", lambda v: v.isNotNull())) < n)) == 0
    per_dataset = rows.groupBy(*keys, "dataset").agg(
        F.avg("selected_score").alias("router"),
        *_slot_means("score", n),
        F.avg(F.array_max("score")).alias("oracle"),
        F.count("*").alias("n"),
        whole.alias("_whole"),
    )
    checked = per_dataset.select(
        *keys,
        "router",
        "oracle",
        "n",
        F.when(F.col("_whole"), _slots(n)).otherwise(F.raise_error(F.lit(INCOMPLETE))).alias("means"),
    )
    return headline_metrics(checked, models, keys)


def headline_metrics(per_dataset: DataFrame, models: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Macro metrics as percentages from one row per (keys, dataset): router, oracle, n and the candidates' means."""
    n = len(models)
    # A dataset is one row here, so the window sorts dataset counts, not samples.
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    macro = F.array(*[F.avg(F.col("means")[i]).over(over) for i in range(n)])
    ready = per_dataset.withColumn("_best", first_best(macro)).select(
        *keys,
        "router",
        "oracle",
        "n",
        "_best",
        (numeric.total(F.col("means")) / F.lit(float(n))).alias("random"),
        F.element_at("means", F.col("_best")).alias("best"),
        F.array_max("means").alias("dataset_best"),
    )

    def pct(c: Column) -> Column:
        return F.avg(c) * 100.0

    return ready.groupBy(*keys).agg(
        pct(F.col("router")).alias("AvgAcc"),
        pct(numeric.safe_relative(F.col("router"), F.col("random"))).alias("GainR"),
        pct(numeric.safe_relative(F.col("router"), F.col("best"))).alias("GainB"),
        pct(numeric.safe_relative(F.col("router"), F.col("oracle"), one_minus=True)).alias("GapO"),
        pct(F.col("best")).alias("BestSingleAvg"),
        pct(F.col("dataset_best")).alias("DatasetOracleAvg"),
        pct(F.col("oracle")).alias("OracleAvg"),
        name_at(models, F.first("_best")).alias("best_single_model"),
        F.count("*").alias("n_datasets"),
        F.sum("n").alias("n_test"),
    )


# ---- picks of many runs side by side: one slot per run in the row -----------------------------------


class Runs:
    """Names of the runs whose picks stand in the array `slots`, in order: (seed, system) pairs, say.

    `support` lists the key values that share their samples (the seed of a run, say); a row has a
    pick of all of them or of none.
    """

    def __init__(self, names: list[tuple], keys: tuple[str, ...], support: int = 1):
        if len(set(names)) < len(names):
            raise ValueError("runs must differ")
        self.names, self.keys = list(names), keys
        self.supports = list(dict.fromkeys(n[:support] for n in names))
        self.group = [self.supports.index(n[:support]) for n in names]

    def of(self, support: int) -> list[int]:
        return [i for i, g in enumerate(self.group) if g == support]

    def tags(self, which: list[int] | None = None) -> Column:
        return F.array(
            *[F.struct(*[F.lit(v).alias(k) for k, v in zip(self.keys, self.names[i], strict=True)]) for i in (which or range(len(self.names)))]
        )


def _covered(runs: Runs, support: int, every: bool) -> Column:
    seen = [F.col("slots")[i].isNotNull() for i in runs.of(support)]
    out = seen[0]
    for c in seen[1:]:
        out = out & c if every else out | c
    return out


def slot_sums(rows: DataFrame, models: list[str], runs: Runs) -> DataFrame:
    """One row per (dataset, run), from one aggregation by dataset: router, means, oracle and n of the rows the run covers.

    `rows` has dataset, the score array and `slots`, the pick (counted from 1, null for none) of every run. Means and
    oracle are added up once per support. Rows that only some runs of a support cover, and incomplete rows, fail the job.
    """
    m, groups = len(models), range(len(runs.supports))
    some = [_covered(runs, g, every=False) for g in groups]
    full = F.size(F.filter("score", lambda v: v.isNotNull())) == m
    aggs = [F.sum(F.element_at("score", F.col("slots")[i])).alias(f"_p{i}") for i in range(len(runs.names))]
    for g in groups:
        aggs += [F.sum(F.when(some[g], F.col("score")[j])).alias(f"_s{g}_{j}") for j in range(m)]
        aggs += [
            F.sum(F.when(some[g], F.array_max("score"))).alias(f"_o{g}"),
            F.count_if(some[g]).alias(f"_n{g}"),
            F.count_if(some[g] & ~_covered(runs, g, every=True)).alias(f"_partly{g}"),
            F.count_if(some[g] & ~full).alias(f"_open{g}"),
        ]
    per = rows.groupBy("dataset").agg(*aggs)
    # One row per dataset from here on.
    mean = lambda c, g: F.when(F.col(f"_n{g}") > 0, F.col(c) / F.col(f"_n{g}"))
    shared = [
        F.struct(
            F.col(f"_n{g}").alias("n"),
            mean(f"_o{g}", g).alias("oracle"),
            F.when(F.col(f"_partly{g}") > 0, F.raise_error(F.lit(UNEQUAL)))
            .when(F.col(f"_open{g}") > 0, F.raise_error(F.lit(INCOMPLETE)))
            .otherwise(F.array(*[mean(f"_s{g}_{j}", g) for j in range(m)]))
            .alias("means"),
        )
        for g in groups
    ]
    tags = runs.tags()
    each = [
        F.struct(tags[i].alias("tag"), mean(f"_p{i}", g).alias("router"), shared[g].alias("of"))
        for i, g in enumerate(runs.group)
    ]
    out = per.select("dataset", F.explode(F.array(*each)).alias("r")).where("r.of.n > 0")
    return out.select(*[F.col(f"r.tag.{k}").alias(k) for k in runs.keys], "dataset", "r.router", "r.of.means", "r.of.oracle", "r.of.n")


def slot_metrics(rows: DataFrame, models: list[str], runs: Runs) -> DataFrame:
    """`benchmark_metrics` of all runs from rows that hold their picks: nothing is shuffled but one row per dataset and task."""
    return headline_metrics(slot_sums(rows, models, runs), models, runs.keys)


def slot_accuracy(rows: DataFrame, runs: Runs) -> DataFrame:
    """Macro accuracy (a share) of every run from rows that hold their picks."""
    cells = [f(F.element_at("score", F.col("slots")[i])).alias(f"_{t}{i}") for i in range(len(runs.names)) for t, f in (("s", F.sum), ("n", F.count))]
    per = rows.groupBy("dataset").agg(*cells)
    tags = runs.tags()
    each = F.array(*[F.struct(tags[i].alias("tag"), (F.col(f"_s{i}") / F.nullif(F.col(f"_n{i}"), F.lit(0))).alias("mean")) for i in range(len(runs.names))])
    rows = per.select(F.explode(each).alias("r"))
    return rows.groupBy(*[F.col(f"r.tag.{k}").alias(k) for k in runs.keys]).agg(F.avg("r.mean").alias("AvgAcc"))


def slot_picks(rows: DataFrame, models: list[str], runs: Runs, *more: str) -> DataFrame:
    """One row per sample and run that covers it: keys, sample_id, dataset, `more`, selected_model, selected_score."""
    each = rows.select("sample_id", "dataset", *more, "score", F.explode(F.arrays_zip(runs.tags().alias("tag"), F.col("slots").alias("slot"))).alias("p"))
    return each.where("p.slot is not null").select(
        *[F.col(f"p.tag.{k}").alias(k) for k in runs.keys], "sample_id", "dataset", *more,
        name_at(models, F.col("p.slot")).alias("selected_model"), F.element_at("score", F.col("p.slot")).alias("selected_score"),
    )


def slot_supports(rows: DataFrame, runs: Runs) -> DataFrame:
    """`support_digest` of every run, and n_mismatches, the rows that only some runs of its support cover; one aggregation to one row."""
    words = _id_words()
    aggs = []
    for i in range(len(runs.names)):
        seen = F.col("slots")[i].isNotNull()
        aggs += [F.count_if(seen).alias(f"_n{i}"), *[F.bit_xor(F.when(seen, w)).alias(f"_d{i}_{k}") for k, w in enumerate(words)]]
    for g in range(len(runs.supports)):
        aggs.append(F.count_if(_covered(runs, g, every=False) & ~_covered(runs, g, every=True)).alias(f"_partly{g}"))
    one = rows.agg(*aggs)
    tags = runs.tags()
    each = [
        F.struct(
            tags[i].alias("tag"), F.col(f"_n{i}").alias("n_ids"), *[F.col(f"_d{i}_{k}").alias(f"digest_{k}") for k in range(len(words))],
            F.col(f"_partly{g}").alias("n_mismatches"),
        )
        for i, g in enumerate(runs.group)
    ]
    out = one.select(F.explode(F.array(*each)).alias("r"))
    return out.select(*[F.col(f"r.tag.{k}").alias(k) for k in runs.keys], "r.n_ids", *[f"r.digest_{k}" for k in range(len(words))], "r.n_mismatches")


def slot_mismatches(rows: DataFrame, runs: Runs, top: int = 10) -> list[tuple]:
    """(support, sample_id) of at most `top` rows that only some runs of a support cover."""
    out = []
    for g, name in enumerate(runs.supports):
        odd = rows.where(_covered(runs, g, every=False) & ~_covered(runs, g, every=True))
        out += [(*name, r.sample_id) for r in odd.select("sample_id").orderBy("sample_id").limit(top).collect()]
    return out[:top]


def sample_std(c) -> Column:
    """Standard deviation with n - 1, 0 for a single row."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def seed_summary(runs: DataFrame) -> DataFrame:
    """Mean and deviation over seeds per system, and the most frequent best single name."""
    stats = [f(m).alias(f"{m}_{tag}") for m in METRICS for tag, f in (("mean", F.avg), ("std", sample_std))]
    return runs.groupBy("system").agg(
        F.count("*").alias("n_seeds"), *stats, F.mode("best_single_model", deterministic=True).alias("best_single_model")
    )


# What each baseline means.
BASELINES = {
    "Best single": (
        "BestSingleAvg",
        "One fixed candidate selected by highest macro Dataset-Avg on the evaluated benchmark support.",
    ),
    "Dataset oracle": ("DatasetOracleAvg", "Best candidate selected separately for each dataset."),
    "Instance oracle": ("OracleAvg", "Best observed candidate selected separately for each query."),
}


def baseline_summary(runs_of_one_system: DataFrame) -> DataFrame:
    """Mean and deviation over seeds of the three baselines; one seed has no deviation."""
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("baseline"), F.lit(d).alias("definition"), F.col(c).alias("v"))
                for k, (c, d) in BASELINES.items()
            ]
        )
    ).alias("b")
    return runs_of_one_system.select(each).groupBy("b.baseline", "b.definition").agg(
        F.avg("b.v").alias("AvgAcc_mean"), F.stddev_samp("b.v").alias("AvgAcc_std")
    )


def duplicate_predictions(predictions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return predictions.groupBy(*keys, "sample_id").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def _id_words() -> list[Column]:
    digest = F.md5("sample_id")
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9)]


def support_digest(ids: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Order-free digest of the id set per key, by exclusive-or of hashes, plus the count.

    Unlike a hash over the sorted ids it needs no list of all ids in one row.
    """
    words = _id_words()
    return ids.groupBy(*keys).agg(
        F.count("*").alias("n_ids"), *[F.bit_xor(w).alias(f"digest_{i}") for i, w in enumerate(words)]
    )


def partly_covered(predictions: DataFrame, keys: tuple[str, ...], unit: str = "system") -> DataFrame:
    """Per key, all ids that some but not all units cover."""
    units = predictions.groupBy(*keys).agg(F.count_distinct(unit).alias("n_units"))
    seen = predictions.groupBy(*keys, "sample_id").agg(F.count_distinct(unit).alias("n_seen"))
    return seen.join(units, list(keys)).where("n_seen < n_units")


def support_mismatches(predictions: DataFrame, keys: tuple[str, ...], unit: str = "system", top: int = 10) -> DataFrame:
    """Per key, ids that some but not all units cover, at most `top` listed per key."""
    odd = partly_covered(predictions, keys, unit)
    # A first cut per hash bucket keeps the final per-key sort small.
    part = Window.partitionBy(*keys, F.substring(F.md5("sample_id"), 1, 3)).orderBy("sample_id")
    few = odd.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= top)
    whole = Window.partitionBy(*keys).orderBy("sample_id")
    return few.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= top).drop("_rn")
