"""Ordered deduplication by aggregation, so a hot key is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# When one sample occurs in several splits, the earlier name wins.
SPLIT_PRIORITY = ("test_3000", "verified", "hybrid", "v1", "test")


def _keep(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest order per key. `order` must tell all rows of a key apart."""
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the least order per key."""
    return _keep(df, keys, order, F.min_by)


def split_rank(split: Column, priority: tuple[str, ...] = SPLIT_PRIORITY) -> Column:
    """Higher is better; 0 for a split that is not listed."""
    rank = F.lit(0)
    for pos, name in enumerate(priority):
        rank = F.when(split == name, len(priority) - pos).otherwise(rank)
    return rank


def samples_by_priority(rows: DataFrame, keys: list[str], seq: list[Column], priority=SPLIT_PRIORITY) -> DataFrame:
    """Best split wins; the first row in scan order among equals."""
    return keep_first(rows, keys, [-split_rank(F.col("split"), priority), *seq])


def outcomes_by_priority(rows: DataFrame, keys: list[str], seq: list[Column], priority=SPLIT_PRIORITY) -> DataFrame:
    """Best split wins; the last row in scan order among equals."""
    return keep_last(rows, keys, [split_rank(F.col("split"), priority), *seq])


def hash_conflicts(rows: DataFrame, keys: list[str], digest: str = "query_hash") -> DataFrame:
    """Keys whose rows disagree on the digest."""
    # min and max stay small for a hot key, unlike a set of its digests.
    found = rows.groupBy(*keys).agg(F.min(digest).alias("first_hash"), F.max(digest).alias("last_hash"))
    return found.where("first_hash <> last_hash")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
