"""Tables in and out: CSV, JSON lines, parquet, embeddings, and file hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointsman import schemas
from pointsman.functions import text


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; texts may hold quotes and line breaks. Ids stay text."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def sink_jsonl(df: DataFrame, path: str) -> None:
    """Canonical JSON lines: keys in order, compact, nulls kept."""
    df.select(text.canonical_json(**{c: F.col(c) for c in df.columns}).alias("value")).write.text(path)


def scan_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decision rows with `_file`, `_block` and `_line`, their place in the input, for last-wins.

    `_line` grows inside a block only; blocks of a file may be read by tasks in any order.
    """
    rows = scan_jsonl(spark, path, schemas.DECISION)
    return rows.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ).where("sample_id is not null")


def last_decisions(rows: DataFrame) -> DataFrame:
    """The last row per sample: by file name, block, then place in the block."""
    from pointsman.operators.features import latest_decisions

    return latest_decisions(rows, [F.col("_file"), F.col("_block"), F.col("_line")]).drop("_file", "_block", "_line")


def scan_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)


def embedding_vectors(embeddings: DataFrame, id_column: str) -> DataFrame:
    """(sample_id, x) with the vector widened to doubles."""
    return embeddings.select(
        F.col(id_column).cast("string").alias("sample_id"), F.col("embedding").cast("array<double>").alias("x")
    )


def join_vectors(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids with their vector; an id without one fails the job."""
    fail = F.raise_error(F.concat(F.lit("no embedding for sample "), F.col("sample_id")))
    rows = ids.join(vectors, "sample_id", "left")
    return rows.withColumn("x", F.when(F.col("x").isNull(), fail).otherwise(F.col("x")))


def sorted_export(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lexical order over the whole output, so a rerun writes the same files."""
    return df.orderBy(*keys)


def sink_tables(samples: DataFrame, outcomes: DataFrame, path: str) -> None:
    """Samples and outcomes, sorted, under one folder."""
    sorted_export(samples, ["sample_id"]).write.parquet(f"{path}/samples")
    sorted_export(outcomes, ["sample_id", "model"]).write.parquet(f"{path}/outcomes")


def sink_runs(predictions: DataFrame, path: str) -> None:
    """One results table for all runs, partitioned by what tells them apart."""
    predictions.write.partitionBy("experiment", "seed", "system").mode("append").parquet(path)


def scan_runs(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """Predictions of all runs; a given experiment prunes the other folders."""
    runs = spark.read.parquet(path)
    return runs.where(F.col("experiment") == experiment) if experiment else runs


def unique_predictions(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows as they are; a repeated sample id (a null one too) fails the job. One aggregation, the input is read once."""
    group = [*keys, "sample_id"]
    rest = [F.first(c).alias(c) for c in runs.columns if c not in group]
    rows = runs.groupBy(*group).agg(F.count("*").alias("_n"), *rest)
    fail = F.raise_error(F.concat(F.lit("duplicate prediction for sample "), F.coalesce(F.col("sample_id").cast("string"), F.lit("null"))))
    return rows.withColumn("sample_id", F.when(F.col("_n") > 1, fail).otherwise(F.col("sample_id"))).select(*runs.columns)


def _stream(path: str):
    """The file system and the path in it, for a store that can be read by blocks; None for one that only Spark reads."""
    try:
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", quote(path, safe="/:@+=,;&$!'()*~")))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return None


def file_hashes(spark: SparkSession, path: str, block: int = 16 << 20) -> DataFrame:
    """(path, length, sha256) of every file that is not empty.

    A file is one row of its path and is hashed by blocks in a task, so it may have any length. In a store that only Spark reads, its
    content is a row's value, which is limited to 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    first = files.select("path").limit(1).collect()
    if not first or _stream(first[0].path) is None:
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column("path").to_pylist():
                store, at = _stream(name)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as f:
                    while part := f.read(block):
                        digest.update(part)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(out, pa.string())], ["path", "length", "sha256"])

    # Without their content, files are dealt evenly by path rather than by size of the listing.
    listed = files.select("path", "length")
    return listed.repartition(F.col("path")).mapInArrow(run, "path string, length long, sha256 string")
