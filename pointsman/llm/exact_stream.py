"""Exact deduplication as a stream with keyed state on disk.

Every row becomes a log record of its digest, its identifier and the place of its content (file
and row). The log is streamed into keyed state that never expires and lives in the embedded disk
store of Structured Streaming, checkpointed to the shared folder: per digest it holds the record
that stays and the number of records. Streaming aggregation combines records of a digest within a
task before they are shuffled, so a digest may have any share of the rows.

Digests with more than one record are hits: their whole texts are grouped byte by byte (combined
within a task first). A digest that stands for different texts is then split by text.

Defined cases: a null text counts as empty; of equal texts the row with the largest doc_id stays
(a null id is smallest, and of equal ids the row last by file and row number stays); repeated rows
are copies of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointsman.llm.common import HOT_SHARE, attach
from pointsman.session import scratch_path, written

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores: without files allotted in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Texts that are no hits leave by a Bloom filter of the hits' digests (8 MB at most) before texts are shuffled, at any size.
FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for the jobs of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(docs: DataFrame, *columns: str) -> tuple[DataFrame, str, str]:
    """`docs` (or `columns` of it) with the file and row of every record, and the names of those two columns.

    A frame that is no plain read of files is written to the shared folder first.
    """
    file, row = (next(n for n in (f"{base}{'_' * i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("_file", "_row"))
    place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    columns = columns or tuple(docs.columns)
    quoted = [F.col(f"`{c}`") for c in columns]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(*quoted, *place), file, row
        except AnalysisException:
            pass
    kept = written(docs.select(F.struct(*quoted).alias("_row_of")), "contents")
    return kept.select(F.col("_row_of"), *place).select("_row_of.*", file, row), file, row


def retained(spark: SparkSession, log_dir: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Streams the log in `log_dir` into the state, as many micro-batches as it has files; the state as a table."""
    at = scratch_path(spark, "exact-state")
    with settings(spark, SETTINGS):
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
        state = log.groupBy("digest").agg(F.max(F.struct("doc_id", "_file", "_row")).alias("keep"), F.count("*").alias("n"))
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start()
        run.awaitTermination()
    held = spark.read.format("statestore").load(at)
    keep, n = held.schema["value"].dataType.names
    return held.select(F.col("key.digest").alias("digest"), F.col(f"value.{keep}").alias("keep"), F.col(f"value.{n}").alias("n"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000, place: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `docs`, with the place of its content (_file, _row).

    `place` names the columns with file and row, if `docs` has them already.
    """
    spark = docs.sparkSession
    docs, file, row = (docs, *place) if place else located(docs, "doc_id", "text")
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("whole"), F.col(file).alias("_file"), F.col(row).alias("_row"))
    docs = docs.withColumn("digest", digest(F.col("whole")))
    log_dir = scratch_path(spark, "exact-log")
    docs.select("doc_id", "_file", "_row", "digest", sha256(F.col("whole")).alias("text_sha256")).write.parquet(log_dir)
    log = spark.read.parquet(log_dir)
    state = written(retained(spark, log_dir, log.schema, files_per_batch), "exact-groups")
    total = log.count()

    # Full bytes of the hits: hot digests, of which there are few, by broadcast; the others by shuffle.
    limit = max(1000, total // HOT_SHARE)
    texts = docs.select("digest", "whole")
    hot, some = state.where(F.col("n") > limit).select("digest"), state.where((F.col("n") > 1) & (F.col("n") <= limit)).select("digest")
    hits = texts.join(F.broadcast(hot), "digest", "left_semi").unionByName(
        texts.join(F.broadcast(hot), "digest", "left_anti").join(some, "digest", "left_semi")
    )
    per_text = hits.groupBy("digest", "whole").agg(F.count("*").alias("n"))
    with settings(spark, FILTER):
        clashes = written(per_text.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "exact-clashes")
    spread = F.xxhash64("_file", "_row")
    if clashes.isEmpty():
        out = attach(log, state, "digest", "n", total, spread)
    else:
        # Records of a digest that stands for several texts are told apart by the text itself.
        record = F.struct("doc_id", "_file", "_row")
        several = docs.join(clashes, "digest", "left_semi")
        by_text = several.groupBy("digest", "whole").agg(F.max(record).alias("keep"), F.count("*").alias("n"))
        several = several.join(by_text, ["digest", "whole"]).withColumn("text_sha256", sha256(F.col("whole"))).select(*log.columns, "keep", "n")
        single = log.join(clashes, "digest", "left_anti").select(*log.columns)
        out = attach(single, state, "digest", "n", total, spread).unionByName(several)
    kept = (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))
    return out.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256", "_file", "_row"
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    places, file, row = located(docs)
    keep = exact_copies(places, place=(file, row)).where("kept").select(F.col("_file").alias(file), F.col("_row").alias(row))
    return places.join(keep, [file, row], "left_semi").drop(file, row)
