"""Incremental semantic enrichment: judge only what has no answer yet."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointsman.functions import text


def pending(samples: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Samples without a result; the first `limit` of them by id when given."""
    todo = samples.join(done.select("sample_id"), "sample_id", "left_anti")
    return todo if limit is None else todo.orderBy("sample_id").limit(limit)


def request_key(query: Column, probe_set: str, model: str) -> Column:
    """Identity of a request: equal ones need one answer."""
    return text.canonical_json_hash(query=query, probe_set=F.lit(probe_set), model=F.lit(model))


def judged(rows: DataFrame, judge: Callable[[str], str], column: str = "query") -> DataFrame:
    """Add `answers` (JSON text) or, where the judge fails, `error`."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, answers string, error string"

    def run(batches):
        for b in batches:
            answers: list[str | None] = []
            errors: list[str | None] = []
            for q in b[column]:
                try:
                    answers.append(judge(q))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - kept as data, so one bad row does not stop the job
                    answers.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield b.assign(answers=pd.Series(answers, index=b.index, dtype=object), error=pd.Series(errors, index=b.index, dtype=object))

    return rows.mapInPandas(run, schema)


LOG = "run string, slice int, attempt string, requested long, completed long, failed long, meta map<string,string>"
RESULT = "sample_id string, answers string, error string, status string, run string, slice int, attempt string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at `path`, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _committed(spark: SparkSession, path: str) -> DataFrame:
    """The line of every committed slice; of several attempts of one, should two jobs have shared a key, the first by name counts."""
    log = _read(spark, f"{path}/log", LOG).where("slice >= 0").groupBy("run", "slice")
    return log.agg(F.min_by(F.struct("attempt", "requested", "completed", "failed"), "attempt").alias("l")).select("run", "slice", "l.*")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Answers and errors of all committed slices under `path`; those of a job that died count for nothing."""
    done = _committed(spark, path).select("run", "slice", "attempt")
    # A row per run and slice.
    return _read(spark, path, RESULT).join(F.broadcast(done), ["run", "slice", "attempt"], "left_semi").select("run", "slice", "sample_id", "answers", "error", "status")


def enrich(
    samples: DataFrame,
    done: DataFrame,
    judge: Callable[[str], str],
    path: str,
    limit: int | None = None,
    run: str = "run",
    meta: dict[str, str] | None = None,
    slices: int = 4,
) -> DataFrame:
    """Judge pending samples under a run key, keep answers and errors under `path`, return the run's counts.

    What a run has to judge is written down first and cut into slices by the hash of the id. A slice's results go
    into `path` itself, which is a plain table, under the name of the attempt, and a line in the log commits that attempt, with the run's metadata. So a job that died and runs again
    with the same key neither doubles rows nor judges a committed slice twice, and a finished run only reports. Samples in `done` or
    answered by another run are not judged.
    """
    spark = samples.sparkSession
    about = F.create_map(*[F.lit(x) for kv in sorted((meta or {}).items()) for x in kv]).cast("map<string,string>") if meta else F.lit(None).cast("map<string,string>")
    log = _read(spark, f"{path}/log", LOG).where(F.col("run") == run)
    # At most a row per slice.
    committed = {r.slice for r in log.collect()}
    # Not named like a partition, which would make `path` a table of mixed folders.
    asked = f"{path}/pending/of-{quote(run, safe='')}"
    if -1 not in committed:
        answered = results(spark, path).where("status = 'ok'").select("sample_id")
        todo = pending(samples, done.select("sample_id").unionByName(answered), limit)
        todo.withColumn("slice", F.pmod(F.xxhash64("sample_id"), F.lit(slices)).cast("int")).write.mode("overwrite").parquet(asked)
        n = spark.read.parquet(asked).agg(F.count("*").alias("requested")).withColumns({"completed": F.lit(0), "failed": F.lit(0)})
        _commit(n, run, -1, None, about, path)
    rows = spark.read.parquet(asked)
    # The slices are those that were written down, whatever is asked for now.
    for s in sorted(r["slice"] for r in rows.select("slice").distinct().collect()):
        if s in committed:
            continue
        status = F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status")
        out = judged(rows.where(F.col("slice") == s).drop("slice"), judge)
        attempt = uuid.uuid4().hex
        named = [F.lit(run).alias("run"), F.lit(s).cast("int").alias("slice"), F.lit(attempt).alias("attempt")]
        out.select(F.col("sample_id").cast("string").alias("sample_id"), "answers", "error", status, *named).write.mode("append").parquet(path)
        written = _read(spark, path, RESULT).where(F.col("attempt") == attempt)
        _commit(written.agg(F.count("*").alias("requested"), F.count_if(F.col("status") == "ok").alias("completed"), F.count_if(F.col("status") == "error").alias("failed")), run, s, attempt, about, path)
    done_now = _committed(spark, path).where(F.col("run") == run)
    return done_now.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requested", "completed", "failed")])


def _commit(counts: DataFrame, run: str, part: int, attempt: str | None, meta: Column, path: str) -> None:
    """One line of the log."""
    line = counts.select(F.lit(run).alias("run"), F.lit(part).alias("slice"), F.lit(attempt).cast("string").alias("attempt"), *[F.col(c).cast("long").alias(c) for c in ("requested", "completed", "failed")], meta.alias("meta"))
    line.coalesce(1).write.mode("append").parquet(f"{path}/log")


def answered_once(
    samples: DataFrame, cache: DataFrame, judge: Callable[[str], str], probe_set: str, model: str
) -> tuple[DataFrame, DataFrame]:
    """(sample rows with answers and `cached`, new cache rows): each distinct request is judged once.

    `cache` has request_key, answers. Distinct requests are formed before the shuffle, so a
    text repeated in many samples is one row there; the final join splits its copies
    through adaptive skew handling.
    """
    keyed = samples.withColumn("request_key", request_key(F.col("query"), probe_set, model))
    requests = keyed.groupBy("request_key").agg(F.min("query").alias("query"))
    fresh = judged(requests.join(cache.select("request_key"), "request_key", "left_anti"), judge)
    new_rows = fresh.where("error is null").select("request_key", "answers")
    known = cache.select("request_key", "answers", F.lit(True).alias("cached")).unionByName(
        fresh.select("request_key", "answers", F.lit(False).alias("cached"))
    )
    return keyed.join(known, "request_key", "left"), new_rows
