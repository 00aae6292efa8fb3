"""Outcomes of one sample side by side: one array slot per candidate.

With the candidate list fixed, a conditional maximum per candidate is a plain hash
aggregate with number buffers. After that one shuffle, picking, oracles, regrets and
utilities are computed inside the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CANDIDATES = 10_000


def candidate_names(outcomes: DataFrame) -> list[str]:
    """Sorted candidate names. The list is part of the plan, so its length is checked."""
    return few_values(outcomes, "model")


def few_values(rows: DataFrame, column: str) -> list:
    """All values of a column, sorted; an error if they are too many to be part of a plan."""
    found = rows.select(column).distinct().limit(MAX_CANDIDATES + 1).collect()
    if len(found) > MAX_CANDIDATES:
        raise ValueError(f"more than {MAX_CANDIDATES} values of {column}")
    return sorted(r[0] for r in found)


def outcome_arrays(
    outcomes: DataFrame, models: list[str], values: tuple[str, ...] = ("score",), keys: tuple[str, ...] = ("sample_id",)
) -> DataFrame:
    """One row per sample with an array per value, in candidate order, null where unobserved.

    Two outcomes of a candidate for a sample are an error.
    """
    cells = [
        F.max(F.when(F.col("model") == m, F.col(v))).alias(f"_{v}_{i}") for v in values for i, m in enumerate(models)
    ]
    twice = F.greatest(*[F.count_if(F.col("model") == m) for m in models], F.lit(0), F.lit(0)).alias("_most")
    # A row with two is not dropped but fails the job when its values are used.
    single = F.assert_true(F.col("_most") <= 1, "two outcomes of a candidate for a sample").isNull()
    arrays = [F.array(*[F.col(f"_{v}_{i}") for i in range(len(models))]) for v in values]
    return outcomes.groupBy(*keys).agg(*cells, twice).select(*keys, *[F.when(single, a).alias(v) for v, a in zip(values, arrays, strict=True)])


def observed(scores) -> "F.Column":
    return F.filter(scores, lambda v: v.isNotNull())


def complete_samples(outcomes: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Ids of samples with an outcome from every candidate of `candidates` (column model), or of the table itself.

    Pass what was scanned: a candidate whose records are all blank has no outcome, yet is expected.
    """
    expected = (candidates if candidates is not None else outcomes).agg(F.count_distinct("model").alias("_expected"))
    per_sample = outcomes.groupBy("sample_id").agg(F.count_distinct("model").alias("_seen"))
    # One row, so the broadcast is of fixed size.
    return per_sample.join(F.broadcast(expected), F.col("_seen") == F.col("_expected"), "left_semi").select("sample_id")


def keep_complete(rows: DataFrame, complete: DataFrame) -> DataFrame:
    return rows.join(complete, "sample_id", "left_semi")


def require_dense(frame: DataFrame, models: list[str], column: str = "score") -> DataFrame:
    """Fail while running on a sample that lacks a candidate."""
    holes = F.size(observed(F.col(column))) < len(models)
    return frame.withColumn(
        column,
        F.when(holes, F.raise_error(F.concat(F.lit("missing outcomes for sample "), F.col("sample_id")))).otherwise(
            F.col(column)
        ),
    )


def wide_columns(arrays: DataFrame, models: list[str], column: str = "score") -> DataFrame:
    """One column per candidate, for export."""
    return arrays.select("sample_id", *[F.col(column)[i].alias(m) for i, m in enumerate(models)])


def sample_frame(
    samples: DataFrame, outcomes: DataFrame, models: list[str], values: tuple[str, ...] = ("score",)
) -> DataFrame:
    """Samples with their outcome arrays; samples without any outcome drop out."""
    return samples.join(outcome_arrays(outcomes, models, values), "sample_id")
