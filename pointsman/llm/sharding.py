"""Shards that all match the corpus mixture, by proportional stratified interleaving (built-in expressions only).

Rows are shuffled by a seeded hash and ranked within their source; the rank as a fraction of the
source's size is the row's place in the whole; cutting the order of places into equal runs gives
every shard each source's share, within a row or so per source.

No window spans a source: a source is cut into buckets of its hash order, each of bounded expected
size, and ranks are offsets of bucket counts plus a rank within the bucket. Places are numbered by a
sort by ranges of (fraction, hash of the source, draw): the fraction alone would put all sources of
one row into one range. So a source may hold any share of the rows, or be as small as a row.

Nulls: a null source is a source of its own, a null text has no bytes, a null id is an id.
Repeated rows are separate rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointsman.llm.common import byte_length, checked
from pointsman.session import written


def _running(counts: DataFrame, bucket: str, *by: str) -> DataFrame:
    """Number of rows before each bucket; a few rows per bucket_rows of the input."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def interleave(docs: DataFrame, shards: int = 40, seed: int = 20, bucket_rows: int = 2_000) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, shard, slot of every row; shard sizes differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stratum = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("stratum")
    order = F.xxhash64(F.lit(seed), F.col("doc_id")).alias("draw")
    keys = docs.select(stratum, order)
    sources = checked(keys.groupBy("stratum").agg(F.count("*").alias("of")))
    n_buckets = F.ceil(F.col("of") / bucket_rows)
    bucket = F.shiftright(F.shiftrightunsigned("draw", 33) * n_buckets, 31).alias("bucket")
    counts = keys.join(sources, "stratum").groupBy("stratum", bucket).agg(F.count("*").alias("n"))
    offsets = checked(_running(counts, "bucket", "stratum").select("stratum", "bucket", "before"))
    rows = docs.select("doc_id", "source", (byte_length(F.col("text")) + 16).alias("size"), F.crc32(text).alias("text_crc32"), stratum, order)
    rows = rows.join(sources, "stratum").withColumn("bucket", bucket).join(offsets, ["stratum", "bucket"])
    within = Window.partitionBy("stratum", "bucket").orderBy("draw", "doc_id", "text_crc32", "size")
    rank = F.col("before") + F.row_number().over(within) - 1
    ranked = rows.withColumn("fraction", (rank + 0.5) / F.col("of")).drop("bucket", "before", "of")
    ranked = written(ranked, "interleave")

    total = ranked.count()
    order = [F.col("fraction"), F.xxhash64(F.lit(seed), "stratum"), F.col("stratum"), F.col("draw"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    place = F.monotonically_increasing_id()
    dealt = ranked.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.select("*", F.shiftright(place, 33).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("local")), "interleave-places")
    # One row per range.
    starts = checked(_running(dealt.groupBy("range").agg(F.count("*").alias("n")), "range").select("range", "before"))
    placed = dealt.join(starts, "range").withColumn("at", F.col("before") + F.col("local"))
    shard = F.expr(f"(at * {shards}) div {max(total, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "fraction", "shard",
        (F.col("at") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).alias("slot"),
    )
