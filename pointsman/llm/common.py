"""What several operators need: table reads and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows; so at most 1,000 keys are.
HOT_SHARE = 1000
#: Summaries up to this many (narrow) rows are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def checked(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small` with a broadcast hint if it has at most `max_rows` rows, else as it is.

    Only the join's physical form follows from the count; its rows are the same.
    """
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Inner join of `rows` with `groups` (one row a key, its number of rows in `size`, adding up to `total`).

    Keys with more than a thousandth of the rows, of which there can be at most a thousand, are
    joined by broadcast. Their rows then pass the shuffled join spread by `spread`, so that no
    task gets more than a thousandth of the rows because of one key.
    """
    limit = max(1000, total // HOT_SHARE)
    names = [c for c in groups.columns if c != key]
    packed = groups.select(F.col(key).alias("_k"), F.struct(*names).alias("_v"))
    hot = packed.where(F.col(f"_v.{size}") > limit).select(F.col("_k").alias("_hk"), F.col("_v").alias("_hv"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").drop("_hk")
    is_hot = F.col("_hv").isNotNull()
    found = found.withColumn("_cold", ~is_hot).withColumn("_at", F.when(is_hot, spread.cast("string")).otherwise(F.col(key).cast("string")))
    cold = packed.where(F.col(f"_v.{size}") <= limit).select(F.col("_k").cast("string").alias("_ck"), F.col("_v").alias("_cv"), F.lit(True).alias("_c"))
    out = found.join(cold, (F.col("_at") == F.col("_ck")) & (F.col("_cold") == F.col("_c")), "left")
    value = F.coalesce(F.col("_hv"), F.col("_cv"))
    return out.where(value.isNotNull()).select(*[F.col(c) for c in rows.columns], *[value[n].alias(n) for n in names])
