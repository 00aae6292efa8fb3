"""Raw result files: one JSON object per dataset, split and candidate."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointsman.functions import text
from pointsman.operators import dedup

# Numbers are read as text first: a score may be written as a number, a text or a boolean.
_RAW_RECORD = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("index", "origin_query", "prompt", "score", "cost", "prompt_tokens", "completion_tokens")
    ]
)
_RAW_FILE = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("demo", T.BooleanType()),
        T.StructField("records", T.ArrayType(_RAW_RECORD)),
        T.StructField("_bad", T.StringType()),
    ]
)


# A file is one record: this separator cannot occur in JSON. In multi-line mode the reader opens a file anew for every number that is read as text.
_WHOLE_FILE = "\x00\x1e\x00\x1f\x00\x1e\x00"


def _filled(c: Column) -> Column:
    return F.when(~text.is_blank(c), text.strip_ws(c))


def path_parts(rel: Column) -> list[Column]:
    """Dataset, split and candidate from a path of at least three folders; `key=` prefixes are dropped."""
    parts = F.split(F.ltrim(rel, F.lit("/")), "/")
    return [
        F.when(F.size(parts) >= 4, F.regexp_replace(F.url_decode(F.get(parts, F.lit(i))), "^[^=]*=", "")) for i in range(3)
    ]


def _literal(path: str) -> str:
    """A file path as the readers take it: not percent-encoded, and no glob."""
    return re.sub(r"([*?\[\]{}])", r"\\\1", unquote(path))


def scan_result_files(spark: SparkSession, root: str, paths: list[str] | None = None, records: bool = True) -> DataFrame:
    """(path, dataset, split, model, demo, records) of every readable result file under `root`, or of `paths` among them.

    Ids come from the payload; when one of them is missing, all come from the path. A file
    with neither, or one that is not JSON, is skipped. Without `records` only headers are kept.
    """
    fields = _RAW_FILE if records else T.StructType([f for f in _RAW_FILE if f.name != "records"])
    raw = (
        spark.read.schema(fields)
        .option("lineSep", _WHOLE_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(root if paths is None else [_literal(p) for p in paths])
        .select("*", F.col("_metadata.file_path").alias("path"))
        .where("_bad is null")
    )
    base = "/" + root.rstrip("/").split("://")[-1].removeprefix("file:").lstrip("/")
    rel = F.regexp_replace("path", f"^.*?{_quoted(base)}/", "")
    ids = [F.coalesce(_filled(F.col("dataset_name")), _filled(F.col("dataset_id"))), _filled(F.col("split")), _filled(F.col("model_name"))]
    whole = ids[0].isNotNull() & ids[1].isNotNull() & ids[2].isNotNull()
    chosen = [F.when(whole, a).otherwise(b).alias(n) for n, a, b in zip(("dataset", "split", "model"), ids, path_parts(rel))]
    demo = F.when(whole, F.coalesce("demo", F.lit(False))).otherwise(False).alias("demo")
    return raw.select("path", *chosen, demo, *(["records"] if records else [])).where("dataset is not null")


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in s)


def filter_pool(
    files: DataFrame,
    datasets: set[str] | None = None,
    models: set[str] | None = None,
    splits: set[str] | None = None,
    skip_demo: bool = True,
) -> DataFrame:
    """Keep wanted datasets (by normalised name), candidates and splits, and drop demo files."""
    out = files
    if skip_demo:
        out = out.where(~F.col("demo"))
    if datasets:
        wanted = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in sorted(datasets)]), text.normalize_name))
        out = out.where(F.array_contains(wanted, text.normalize_name(F.col("dataset"))))
    if models:
        out = out.where(F.col("model").isin(sorted(m.strip() for m in models)))
    if splits:
        out = out.where(F.col("split").isin(sorted(s.strip() for s in splits)))
    return out


def latest_artifact(files: DataFrame, lexical: bool = False) -> DataFrame:
    """(dataset, split, model, path): the file with the latest name time, then the last path.

    With `lexical` the last path alone decides.
    """
    order = [F.col("path")] if lexical else [text.filename_timestamp(F.col("path")), F.col("path")]
    return dedup.keep_last(files.select("dataset", "split", "model", "path"), ["dataset", "split", "model"], order)


def _number(c: Column) -> Column:
    n = F.coalesce(c.try_cast("double"), F.when(F.lower(c) == "true", 1.0))
    return F.coalesce(n, F.lit(0.0))


def explode_records(files: DataFrame) -> DataFrame:
    """One row per record; a record without an index takes its position, a missing number is 0."""
    rows = files.select("path", "dataset", "split", "model", F.posexplode("records").alias("pos", "r"))
    return rows.select(
        "path",
        "dataset",
        "split",
        "model",
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(F.col("r.index").cast("string"), F.col("pos").cast("string")).alias("index"),
        F.col("r.origin_query").alias("origin_query"),
        F.col("r.prompt").alias("prompt"),
        _number(F.col("r.score")).alias("score"),
        _number(F.col("r.cost")).alias("cost"),
        _number(F.col("r.prompt_tokens")).cast("long").alias("prompt_tokens"),
        _number(F.col("r.completion_tokens")).cast("long").alias("completion_tokens"),
    )


def load_records(spark: SparkSession, root: str, lexical: bool = False, **pool) -> DataFrame:
    """Records of the selected files: headers choose the latest file per (dataset, split, model), and only those files are read for their records."""
    headers = filter_pool(scan_result_files(spark, root, records=False), **pool)
    # A path per file that is read, as the reader lists it anyway.
    paths = sorted(r.path for r in latest_artifact(headers, lexical).select("path").collect())
    files = scan_result_files(spark, root, paths) if paths else scan_result_files(spark, root).limit(0)
    return explode_records(files)
