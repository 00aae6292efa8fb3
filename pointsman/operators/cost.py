"""Quality-cost trade-off: the lambda sweep, its frontier and its operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointsman.functions import numeric
from pointsman.operators import ranking, routing

LAMBDAS = [i / 20 for i in range(21)]


def lambda_grid(frame: DataFrame, lambdas: list[float] = LAMBDAS) -> DataFrame:
    """Every row once per lambda. The grid is a literal in the plan, so nothing is joined."""
    return frame.withColumn("lambda", F.explode(F.array(*[F.lit(float(v)) for v in lambdas])))


def sweep_picks(
    frame: DataFrame,
    models: list[str],
    bounds: dict[str, tuple[float, float]],
    lambdas: list[float] = LAMBDAS,
    quality: str = "pred",
    cost: str = "pred_cost",
) -> DataFrame:
    """Per sample and lambda, the pick among observed candidates.

    `frame` has score and cost arrays (null where unobserved) and predicted quality and
    cost arrays; `bounds` scales both predictions. Predictions are scaled and masked once
    per sample; then the grid multiplies the rows, and the best of the candidates' utility
    columns is taken in generated code.
    """
    n = range(len(models))
    keep = [c for c in ("seed", "sample_id", "dataset") if c in frame.columns]

    def scaled(c: str, i: int) -> Column:
        low, high = bounds[c]
        return numeric.minmax(F.col(c)[i], F.lit(low), F.lit(high), numeric.TINY)

    usable = [numeric.is_finite(F.col("score")[i]) & numeric.is_finite(F.col("cost")[i]) for i in n]
    flat = frame.select(
        *keep,
        "score",
        "cost",
        routing.available(F.col("score"), F.col("cost")).alias("available_models"),
        *[F.when(usable[i], scaled(quality, i)).alias(f"_q{i}") for i in n],
        *[scaled(cost, i).alias(f"_c{i}") for i in n],
    )
    value = [numeric.utility(F.col(f"_q{i}"), F.col(f"_c{i}"), F.col("lambda")) for i in n]
    rows = lambda_grid(flat, lambdas).select(
        *keep, "lambda", "score", "cost", "available_models", *[v.alias(f"_u{i}") for i, v in enumerate(value)]
    )
    best = F.greatest(*[F.col(f"_u{i}") for i in n]) if len(models) > 1 else F.col("_u0")
    # The first candidate that reaches the best utility.
    slot = F.coalesce(*[F.when(F.col(f"_u{i}") == F.col("_best"), i + 1) for i in n])
    slot = F.coalesce(slot, F.raise_error("no candidate with score and cost for a sample").cast("int"))
    rows = rows.withColumn("_best", best).withColumn("_slot", slot)
    return rows.select(
        *keep,
        "lambda",
        routing.name_at(models, F.col("_slot")).alias("selected_model"),
        F.element_at("score", F.col("_slot")).alias("selected_score"),
        F.element_at("cost", F.col("_slot")).alias("selected_cost"),
        "available_models",
    )


def sweep_metrics(picks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per lambda: macro accuracy, cost totals and availability, without the frontier flag."""
    per_dataset = picks.groupBy(*keys, "lambda", "dataset").agg(
        F.avg("selected_score").alias("acc"),
        F.sum("selected_cost").alias("cost"),
        F.count("*").alias("n"),
        F.min("available_models").alias("low"),
        F.sum("available_models").alias("total"),
    )
    return per_dataset.groupBy(*keys, "lambda").agg(
        F.avg("acc").alias("AvgAcc"),
        F.sum("cost").alias("total_cost"),
        (F.sum("cost") / F.sum("n")).alias("mean_cost"),
        F.min("low").alias("min_available_models"),
        (F.sum("total") / F.sum("n")).alias("mean_available_models"),
    )


def pareto_flags(points: DataFrame, score: str = "AvgAcc", cost: str = "total_cost", keys: tuple[str, ...] = ()) -> DataFrame:
    """Flag points that no other point beats: no cheaper or equal one scores as well with one of both strict.

    A point stays when it has the best score at its own cost and beats every strictly
    cheaper point. Best scores per cost are prefix-maximised bucket by bucket, so large
    point sets need no global sort and no comparison of all pairs.
    """
    const = [] if keys else ["_all"]
    strata = [*keys, *const]
    points = points.persist()
    per_cost = points.groupBy(*keys, cost).agg(F.max(score).alias("_top"))
    rows = ranking.value_buckets(per_cost, list(keys), cost)
    for c in const:
        rows = rows.withColumn(c, F.lit(0))
    tops = rows.groupBy(*strata, "_bucket").agg(F.max("_top").alias("_bucket_top"))
    earlier = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*strata, "_bucket", F.max("_bucket_top").over(earlier).alias("_carried"))
    cheaper = Window.partitionBy(*strata, "_bucket").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    best_below = F.greatest(F.max("_top").over(cheaper), F.col("_carried"))
    limits = rows.join(carried, [*strata, "_bucket"]).select(
        *keys, F.col(cost).alias("_cost"), "_top", best_below.alias("_below")
    )
    same = [F.col(f"p.{k}") == F.col(f"l.{k}") for k in keys] + [F.col(f"p.{cost}") == F.col("l._cost")]
    joined = points.alias("p").join(limits.alias("l"), same)
    kept = (F.col(f"p.{score}") == F.col("_top")) & (F.col("_below").isNull() | (F.col("_top") > F.col("_below")))
    return joined.select("p.*", kept.alias("pareto"))


def theta_star(sweep: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Best accuracy; the smallest lambda on ties."""
    row = F.struct(*sweep.columns)
    best = sweep.groupBy(*keys).agg(F.min_by(row, F.struct(-F.col("AvgAcc"), F.col("lambda"))).alias("_r"))
    return best.select("_r.*")


def theta_dagger(sweep: DataFrame, baseline: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cheapest point whose accuracy reaches the baseline; the smallest lambda on ties; maybe none."""
    row = F.struct(*sweep.columns)
    fit = sweep.where(F.col("AvgAcc") >= baseline - numeric.TINY)
    best = fit.groupBy(*keys).agg(F.min_by(row, F.struct("total_cost", "lambda")).alias("_r"))
    return best.where("_r is not null").select("_r.*")


def baseline_candidates(frame: DataFrame, models: list[str]) -> DataFrame:
    """Per candidate: macro accuracy, total cost and whether every sample is observed."""
    both = F.arrays_zip(
        F.array(*[F.lit(m) for m in models]).alias("model"), F.col("score").alias("score"), F.col("cost").alias("cost")
    )
    rows = frame.select("sample_id", "dataset", F.explode(both).alias("o")).select("dataset", "o.*")
    usable = numeric.is_finite(F.col("score")) & numeric.is_finite(F.col("cost"))
    per_dataset = rows.groupBy("model", "dataset").agg(
        F.avg("score").alias("acc"), F.sum("cost").alias("cost"), F.count_if(~usable).alias("missing")
    )
    return per_dataset.groupBy("model").agg(
        F.avg("acc").alias("AvgAcc"), F.sum("cost").alias("total_cost"), F.sum("missing").alias("missing")
    )


def select_baseline(frame: DataFrame, models: list[str], named: str | None = None) -> DataFrame:
    """The named reference, or the complete candidate of the best macro accuracy."""
    table = baseline_candidates(frame, models)
    if named is not None:
        if named not in models:
            raise ValueError(f"baseline {named!r} is not a candidate")
        fail = F.raise_error(F.lit(f"baseline {named!r} is unobserved on some samples"))
        table = table.where(F.col("model") == named).withColumn(
            "AvgAcc", F.when(F.col("missing") > 0, fail).otherwise(F.col("AvgAcc"))
        )
    best = table.where("missing = 0").agg(
        F.min_by(F.struct("model", "AvgAcc", "total_cost"), F.struct(-F.col("AvgAcc"), F.col("model"))).alias("b")
    )
    return best.select(
        F.col("b.model").alias("baseline_model"),
        F.col("b.AvgAcc").alias("baseline_acc"),
        F.col("b.total_cost").alias("baseline_cost"),
    )


def baseline_supported(frame: DataFrame, models: list[str], baseline: str) -> DataFrame:
    """Add `supported`: the fixed reference has an observed score and cost for the sample."""
    i = models.index(baseline)
    return frame.withColumn(
        "supported", numeric.is_finite(F.col("score")[i]) & numeric.is_finite(F.col("cost")[i])
    )


def perf_gain(accuracy: Column, baseline: Column) -> Column:
    """Relative accuracy gain in percent; null without a baseline accuracy."""
    return (F.when(baseline != 0, accuracy / baseline) - 1.0) * 100.0


def cost_save(cost: Column, baseline: Column) -> Column:
    """Relative cost saving in percent; null without a positive baseline cost."""
    return (1.0 - F.when(baseline > 0, cost / baseline)) * 100.0


def model_coverage(frame: DataFrame, models: list[str], train: Column, test: Column) -> DataFrame:
    """Per candidate: observed test rows, their share in percent and observed train scores."""
    both = F.arrays_zip(
        F.array(*[F.lit(m) for m in models]).alias("model"), F.col("score").alias("score"), F.col("cost").alias("cost")
    )
    rows = frame.select(train.alias("_train"), test.alias("_test"), F.explode(both).alias("o")).select(
        "_train", "_test", "o.*"
    )
    usable = numeric.is_finite(F.col("score")) & numeric.is_finite(F.col("cost"))
    return rows.groupBy("model").agg(
        F.count_if(F.col("_test") & usable).alias("test_available"),
        (F.count_if(F.col("_test") & usable) * 100.0 / F.count_if("_test")).alias("test_coverage_pct"),
        F.count_if(F.col("_train") & F.col("score").isNotNull()).alias("train_available"),
    )


def seed_summary(runs: DataFrame) -> DataFrame:
    """Over seeds: mean and deviation of the gain, and counts of positive and of reported savings."""
    return runs.agg(
        F.avg("PerfGain_pct").alias("PerfGain_pct_mean"),
        F.stddev_samp("PerfGain_pct").alias("PerfGain_pct_std"),
        F.count_if(F.col("PerfGain_pct") > 0).alias("positive_PerfGain_seeds"),
        F.count("CostSave_pct").alias("strict_CostSave_reported_seeds"),
        F.count_if(F.col("CostSave_pct") > 0).alias("positive_strict_CostSave_seeds"),
    )
