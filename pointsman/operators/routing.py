"""Routing policies over arrays of predicted quality and cost, all inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointsman.functions import numeric

def first_best(values: Column) -> Column:
    """1-based slot of the greatest value; the first one on ties, so the first name in order."""
    return F.array_position(values, F.array_max(values)).cast("int")


def name_at(models: list[str], slot: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in models]), slot)


def margin(values: Column) -> Column:
    """Best minus second best; infinite with a single candidate."""
    top = F.sort_array(values, asc=False)
    return F.when(F.size(values) > 1, F.get(top, F.lit(0)) - F.get(top, F.lit(1))).otherwise(float("inf"))


def masked(values: Column, score: Column, cost: Column) -> Column:
    """Null for an unavailable candidate: it needs both an observed score and cost.

    Null, not minus infinity: a weight of 0 would turn that into NaN, which sorts greatest.
    """
    usable = F.zip_with(score, cost, lambda s, c: numeric.is_finite(s) & numeric.is_finite(c))
    return F.zip_with(values, usable, lambda v, ok: F.when(ok, v))


def available(score: Column, cost: Column) -> Column:
    both = F.zip_with(score, cost, lambda s, c: (numeric.is_finite(s) & numeric.is_finite(c)).cast("long"))
    return F.aggregate(both, F.lit(0).cast("long"), lambda a, v: a + v)


def utilities(quality: Column, cost: Column, lam: Column) -> Column:
    return F.zip_with(quality, cost, lambda q, c: numeric.utility(q, c, lam))


def selected(frame: DataFrame, models: list[str], pred: str = "pred", slot: str | None = None) -> DataFrame:
    """Pick per sample with achieved score, oracle, regret and prediction margin."""
    row = frame.withColumn("_slot", F.col(slot) if slot else first_best(F.col(pred)))
    keep = [c for c in frame.columns if c not in {pred, "score", "cost", "x", slot}]
    achieved = F.element_at("score", F.col("_slot"))
    return row.select(
        *keep,
        name_at(models, F.col("_slot")).alias("selected_model"),
        achieved.alias("selected_score"),
        F.array_max("score").alias("oracle_score"),
        (F.array_max("score") - achieved).alias("regret"),
        margin(F.col(pred)).alias("prediction_margin"),
    )


def best_elsewhere(frame: DataFrame, models: list[str], column: str) -> DataFrame:
    """(column, best): per value of `column`, the slot of the candidate with the best mean score over all other rows."""
    n = len(models)
    sums = [F.sum(F.col("score")[i]).alias(f"_s{i}") for i in range(n)]
    counts = [F.count(F.col("score")[i]).alias(f"_n{i}") for i in range(n)]
    per = frame.groupBy(column).agg(*sums, *counts)
    # One row per value from here on.
    whole = per.agg(*[F.sum(f"_{k}{i}").alias(f"_all_{k}{i}") for k in "sn" for i in range(n)])
    rest = F.array(*[(F.col(f"_all_s{i}") - F.coalesce(f"_s{i}", F.lit(0.0))) / F.nullif(F.col(f"_all_n{i}") - F.col(f"_n{i}"), F.lit(0)) for i in range(n)])
    # Sums in varying order: equal means are told apart no finer than this.
    return per.join(F.broadcast(whole)).select(column, first_best(F.transform(rest, lambda v: F.round(v, 12))).alias("best"))


def selected_with_cost(frame: DataFrame, models: list[str], value: str = "pred") -> DataFrame:
    """Pick among observed candidates with its score and cost and the number available."""
    best = first_best(masked(F.col(value), F.col("score"), F.col("cost")))
    row = frame.withColumn("_slot", F.coalesce(best, F.raise_error("no candidate with score and cost for a sample").cast("int")))
    keep = [c for c in frame.columns if c not in {value, "score", "cost", "x"}]
    return row.select(
        *keep,
        name_at(models, F.col("_slot")).alias("selected_model"),
        F.element_at("score", F.col("_slot")).alias("selected_score"),
        F.element_at("cost", F.col("_slot")).alias("selected_cost"),
        available(F.col("score"), F.col("cost")).alias("available_models"),
    )


def ranked(frame: DataFrame, models: list[str], top_k: int = 5, pred: str = "pred") -> DataFrame:
    """The best k candidates per sample, one row each, with the observed score where known."""
    k = max(1, min(int(top_k), len(models)))
    slots = F.transform(F.col(pred), lambda v, i: F.struct((-v).alias("key"), (i + 1).cast("int").alias("slot")))
    keep = [c for c in frame.columns if c not in {pred, "score", "cost", "x"}]
    has_score = "score" in frame.columns
    rows = frame.select(
        *keep,
        *(["score"] if has_score else []),
        F.posexplode(F.slice(F.sort_array(slots), 1, k)).alias("_pos", "_best"),
    )
    return rows.select(
        *keep,
        (F.col("_pos") + 1).cast("long").alias("rank"),
        name_at(models, F.col("_best.slot")).alias("model"),
        (-F.col("_best.key")).alias("predicted_score"),
        *([F.element_at("score", F.col("_best.slot")).alias("observed_score")] if has_score else []),
    )


def candidate_bounds(frame: DataFrame, columns: list[str], n_models: int) -> DataFrame:
    """One row: least and greatest value per candidate of each array column."""
    cells = [
        f(F.col(c)[i]).alias(f"{c}_{tag}_{i}")
        for c in columns
        for i in range(n_models)
        for tag, f in (("low", F.min), ("high", F.max))
    ]
    return frame.agg(*cells).select(
        *[
            F.array(*[F.col(f"{c}_{tag}_{i}") for i in range(n_models)]).alias(f"{c}_{tag}")
            for c in columns
            for tag in ("low", "high")
        ]
    )


def route_cost_aware(frame: DataFrame, models: list[str], lam: float, quality: str = "pred", cost: str = "pred_cost") -> DataFrame:
    """Column-normalised utility, then the best slot: adds `slot` and `value`."""
    if not 0 <= lam <= 1:
        raise ValueError("lam must be in [0, 1]")
    bounds = candidate_bounds(frame, [quality, cost], len(models))

    def scaled(c: str) -> Column:
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        return F.transform(F.col(c), lambda v, i: numeric.minmax(v, F.get(low, i), F.get(high, i)))

    value = utilities(scaled(quality), scaled(cost), F.lit(float(lam)))
    # The bounds are one row of fixed width.
    return (
        frame.join(F.broadcast(bounds))
        .withColumn("value", value)
        .withColumn("slot", first_best(F.col("value")))
        .drop(*bounds.columns)
    )


def global_bounds(frame: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """One least and one greatest value over all cells of each array column."""
    aggs = [f(g(c)).alias(f"{c}_{tag}") for c in columns for tag, f, g in (("low", F.min, F.array_min), ("high", F.max, F.array_max))]
    row = frame.agg(*aggs).first()
    return {c: (float(row[f"{c}_low"]), float(row[f"{c}_high"])) for c in columns}


def scaled_globally(c: str, bounds: dict[str, tuple[float, float]]) -> Column:
    low, high = bounds[c]
    return F.transform(F.col(c), lambda v: numeric.minmax(v, F.lit(low), F.lit(high), numeric.TINY))


def route_or_abstain(uncertainty: Column, threshold: Column, router: Column, fallback: Column) -> Column:
    return F.when(uncertainty <= threshold, router).otherwise(fallback)


def pick_long(predictions: DataFrame, value: str = "pred") -> DataFrame:
    """The best candidate per sample of a long prediction table; ties go to the first name."""
    best = F.min(F.struct((-F.col(value)).alias("key"), F.col("model"))).alias("_best")
    return predictions.groupBy("sample_id").agg(best).select(
        "sample_id", F.col("_best.model").alias("selected_model"), (-F.col("_best.key")).alias(value)
    )


def probe_ranks(contributions: DataFrame, keep: int) -> DataFrame:
    """Rank probes per outer fold by contribution, original position on ties; flag the kept ones."""
    # One row per (fold, probe): a handful per window group.
    w = Window.partitionBy("outer_fold").orderBy(F.desc("contribution_pp"), "position")
    return contributions.withColumn("rank", F.row_number().over(w).cast("long")).withColumn(
        "selected", F.col("rank") <= keep
    )
