"""Release and pool checks as one table of (check, passed, observed)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointsman.operators import audits, dedup, features
from pointsman.operators.features import FeatureSet


@dataclass(frozen=True)
class Expected:
    samples: int
    datasets: int
    models: int
    outcomes: int
    features: int = 40
    reference_model: str | None = None


# Sizes of the two published pools.
PERFORMANCE = Expected(11_481, 15, 20, 229_620)
PERFORMANCE_COST = Expected(12_446, 10, 13, 161_520, reference_model="gpt-5")


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("v"))


def _distinct(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("v"))


def _equals(name: str, observed: DataFrame, expected: int) -> DataFrame:
    return audits.check(name, observed, F.col("v") == expected)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def pool_checks(label: str, samples: DataFrame, outcomes: DataFrame, expected: Expected, counts: DataFrame | None = None) -> DataFrame:
    """Sizes, key uniqueness, support equality and, when given, the per-dataset counts of one pool."""
    out = [
        _equals(f"{label}: samples", _count(samples), expected.samples),
        _equals(f"{label}: datasets", _distinct(samples, "dataset"), expected.datasets),
        _equals(f"{label}: outcomes", _count(outcomes), expected.outcomes),
        _equals(f"{label}: models", _distinct(outcomes, "model"), expected.models),
        _equals(f"{label}: duplicate samples", _count(dedup.duplicates(samples, ["sample_id"])), 0),
        _equals(f"{label}: duplicate outcomes", _count(dedup.duplicates(outcomes, ["sample_id", "model"])), 0),
        _equals(f"{label}: samples without outcome", _count(samples.join(outcomes, "sample_id", "left_anti")), 0),
        _equals(f"{label}: outcomes without sample", _count(outcomes.join(samples, "sample_id", "left_anti")), 0),
    ]
    if counts is not None:
        wrong = audits.dataset_counts(samples, counts).where("delta <> 0")
        out.append(_equals(f"{label}: datasets of another size", _count(wrong), 0))
    if expected.reference_model is not None:
        seen = outcomes.where(F.col("model") == expected.reference_model).limit(1)
        out.append(_equals(f"{label}: reference candidate", _count(seen), 1))
    return _union(out)


def feature_checks(label: str, fs: FeatureSet, backend: str, samples: DataFrame, expected: Expected) -> DataFrame:
    """Rows, ids, width, range and support of one feature table, from one aggregate and two anti joins."""
    q = features.quality_check(fs, backend)
    named = {
        "rows": ("n_rows", expected.samples),
        "ids": ("n_ids", expected.samples),
        "features": ("n_features", expected.features),
        "not finite": ("n_not_finite", 0),
        "out of range": ("n_out_of_range", 0),
    }
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"{label}: {k}").alias("check"), (F.col(c) == v).alias("passed"), F.col(c).cast("string").alias("observed")
                )
                for k, (c, v) in named.items()
            ]
        )
    ).alias("c")
    missing = samples.join(fs.df, "sample_id", "left_anti")
    extra = fs.df.join(samples, "sample_id", "left_anti")
    return _union(
        [
            q.select(each).select("c.*"),
            _equals(f"{label}: samples without features", _count(missing), 0),
            _equals(f"{label}: features without sample", _count(extra), 0),
        ]
    )


def prediction_checks(label: str, predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Frozen predictions cover every sample exactly once."""
    return _union(
        [
            _equals(f"{label}: duplicate predictions", _count(dedup.duplicates(predictions, ["sample_id"])), 0),
            _equals(f"{label}: samples without prediction", _count(samples.join(predictions, "sample_id", "left_anti")), 0),
            _equals(f"{label}: predictions without sample", _count(predictions.join(samples, "sample_id", "left_anti")), 0),
        ]
    )


def vector_checks(label: str, vectors: DataFrame, samples: DataFrame) -> DataFrame:
    """Embeddings cover every sample with vectors of one dimension."""
    dims = vectors.agg(F.count_distinct(F.size("x")).alias("v"))
    return _union(
        [
            _equals(f"{label}: dimensions", dims, 1),
            _equals(f"{label}: samples without vector", _count(samples.join(vectors, "sample_id", "left_anti")), 0),
        ]
    )


def failed(checks: DataFrame) -> DataFrame:
    return checks.where(~F.col("passed"))
