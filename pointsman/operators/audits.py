"""Count, support and alignment audits of outcome pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointsman.functions import text


def dataset_counts(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """(dataset, expected, actual, delta) over the names of either side. `expected` has dataset, expected."""
    actual = samples.groupBy(text.normalize_name(F.col("dataset")).alias("dataset")).agg(F.count("*").alias("actual"))
    both = actual.join(expected, "dataset", "full_outer").fillna(0, ["expected", "actual"])
    return both.select("dataset", "expected", "actual", (F.col("actual") - F.col("expected")).alias("delta"))


def identity_counts(records: DataFrame) -> DataFrame:
    """Per dataset: candidates, least and most records of one, distinct query and prompt texts."""
    name = text.normalize_name(F.col("dataset")).alias("dataset")
    rows = records.select(name, "model", "origin_query", "prompt")
    counts = rows.groupBy("dataset", "model").agg(F.count("*").alias("n")).groupBy("dataset").agg(
        F.count("*").alias("n_models"), F.min("n").alias("records_min_model"), F.max("n").alias("records_max_model")
    )

    def distinct(field: str) -> DataFrame:
        kept = rows.where(~text.is_blank(F.col(field))).select("dataset", text.query_hash(F.col(field)).alias("h"))
        return kept.distinct().groupBy("dataset").agg(F.count("*").alias(f"{field}_union"))

    out = counts.join(distinct("origin_query"), "dataset", "left").join(distinct("prompt"), "dataset", "left")
    out = out.fillna(0, ["origin_query_union", "prompt_union"])
    return out.withColumn("prompt_minus_origin", F.col("prompt_union") - F.col("origin_query_union"))


def index_alignment(records: DataFrame, expected_models: list[str], top: int = 20) -> DataFrame:
    """Problems of the record-index sets of one dataset: (problem, model, index).

    missing_model: an expected candidate without records; duplicate: an index twice in one
    candidate's file; missing and extra: difference from the first candidate by name, at
    most `top` listed per candidate. No rows means every candidate has the same unique set.
    """
    seen = records.groupBy("model", "index").agg(F.count("*").alias("n"))
    models = seen.select("model").distinct()
    spark = records.sparkSession
    wanted = spark.createDataFrame([(m,) for m in sorted(expected_models)], "model string")
    none = F.lit(None).cast("string").alias("index")
    missing_models = wanted.join(models, "model", "left_anti").select(F.lit("missing_model").alias("problem"), "model", none)
    duplicate = seen.where("n > 1").select(F.lit("duplicate").alias("problem"), "model", "index")
    n_models = models.agg(F.count("*").alias("n_models"), F.min("model").alias("first_model"))
    # Per index: which candidates have it. A set of at most as many names as candidates.
    per_index = seen.groupBy("index").agg(F.collect_set("model").alias("have")).join(F.broadcast(n_models))
    odd = per_index.where(F.size("have") < F.col("n_models"))
    in_first = F.array_contains("have", F.col("first_model"))
    names = models.agg(F.sort_array(F.collect_set("model")).alias("names"))
    lacking = odd.where(in_first).join(F.broadcast(names)).select(
        F.lit("missing").alias("problem"), F.explode(F.array_except("names", "have")).alias("model"), "index"
    )
    extra = odd.where(~in_first).select(F.lit("extra").alias("problem"), F.explode("have").alias("model"), "index")
    both = lacking.unionByName(extra)
    part = Window.partitionBy("problem", "model", F.substring(F.md5("index"), 1, 3)).orderBy("index")
    few = both.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= top)
    whole = Window.partitionBy("problem", "model").orderBy("index")
    listed = few.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= top).drop("_rn")
    return missing_models.unionByName(duplicate).unionByName(listed)


def support_matrix(outcomes: DataFrame, samples: DataFrame, models: list[str], hole: Column | None = None) -> DataFrame:
    """(dataset, model, expected, actual) where the distinct samples differ from the expected grid.

    The grid is every dataset with every candidate, but for the cells where `hole` is true.
    """
    actual = outcomes.groupBy("dataset", "model").agg(F.count_distinct("sample_id").alias("actual"))
    sizes = samples.groupBy("dataset").agg(F.count("*").alias("expected"))
    grid = sizes.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    if hole is not None:
        grid = grid.where(~hole)
    both = grid.join(actual, ["dataset", "model"], "full_outer").fillna(0, ["expected", "actual"])
    return both.select("dataset", "model", "expected", "actual")


def model_sample_counts(outcomes: DataFrame) -> DataFrame:
    """(model, samples): distinct samples with a score per candidate."""
    return outcomes.where("score is not null").groupBy("model").agg(F.count_distinct("sample_id").alias("samples"))


def set_difference(left: DataFrame, right: DataFrame, top: int = 10) -> DataFrame:
    """(side, sample_id): up to `top` ids found on one side only, in id order."""

    def only(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
        odd = a.select("sample_id").distinct().join(b.select("sample_id").distinct(), "sample_id", "left_anti")
        return odd.orderBy("sample_id").limit(top).select(F.lit(side).alias("side"), "sample_id")

    return only(left, right, "left_only").unionByName(only(right, left, "right_only"))


def check(name: str, observed: DataFrame, passed: Column) -> DataFrame:
    """One (check, passed, observed) row from a one-row table with a column `v`."""
    return observed.select(
        F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), F.col("v").cast("string").alias("observed")
    )


def require_columns(df: DataFrame, columns: set[str], label: str) -> None:
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing columns {missing}")
