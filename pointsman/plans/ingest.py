"""From result records to sample and outcome tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointsman.functions import text
from pointsman.operators import audits, dedup, matrix

OUTCOME_VALUES = ("score", "cost", "prompt_tokens", "completion_tokens")
SCAN_ORDER = ("dataset", "split", "model", "pos")


@dataclass(frozen=True)
class Pool:
    samples: DataFrame
    outcomes: DataFrame


def _ordered(rows: DataFrame) -> list[Column]:
    return [F.col(c) for c in SCAN_ORDER if c in rows.columns]


def _finish(samples: DataFrame, outcomes: DataFrame, complete_only: bool, records: DataFrame) -> Pool:
    samples = samples.select("sample_id", "dataset", "split", "record_index", "query", "query_hash", "domain")
    outcomes = outcomes.select("sample_id", "dataset", "split", "model", *OUTCOME_VALUES)
    if complete_only:
        keep = matrix.complete_samples(outcomes, records.select("model"))
        samples, outcomes = matrix.keep_complete(samples, keep), matrix.keep_complete(outcomes, keep)
    return Pool(samples, outcomes)


def identified(
    records: DataFrame,
    identity: str = "origin_query",
    identity_by_dataset: dict[str, str] | None = None,
    collapse_splits: bool = False,
) -> DataFrame:
    """Add query, query_hash, sample_id, domain and the identity key `unit`; drop records without text.

    `identity` is origin_query, prompt or record_index, and may differ by dataset.
    """
    rule = F.lit(identity)
    for name, other in (identity_by_dataset or {}).items():
        rule = F.when(text.normalize_name(F.col("dataset")) == name, other).otherwise(rule)
    prompt, origin = F.col("prompt"), F.col("origin_query")
    query = F.when(rule == "origin_query", text.identity_text(prompt, origin, "origin_query")).otherwise(
        text.identity_text(prompt, origin, "prompt")
    )
    rows = records.withColumn("query", query).where("query is not null")
    rows = rows.withColumn("query_hash", text.query_hash(F.col("query")))
    parts = (F.col("dataset"), F.col("split"), F.col("index"), F.col("query_hash"))
    tail = "" if collapse_splits else "_split"
    sid = F.when(rule == "record_index", text.sample_id("index" + tail, *parts)).otherwise(
        text.sample_id("content" + tail, *parts)
    )
    unit = F.when(rule == "record_index", F.concat(F.lit("idx:"), F.col("index"))).otherwise(F.col("query_hash"))
    return rows.select(
        "*", sid.alias("sample_id"), unit.alias("unit"), F.col("index").alias("record_index"),
        text.domain_of(F.col("dataset")).alias("domain"),
    )


def ingest_generic(
    records: DataFrame,
    complete_only: bool = True,
    identity: str = "origin_query",
    identity_by_dataset: dict[str, str] | None = None,
    collapse_splits: bool = False,
    priority: tuple[str, ...] = (),
) -> Pool:
    """Samples by identity, with splits collapsed by priority when asked; one outcome per sample and candidate."""
    rows = identified(records, identity, identity_by_dataset, collapse_splits)
    key = ["dataset", "unit"] if collapse_splits else ["dataset", "split", "unit"]
    samples = dedup.samples_by_priority(
        rows.select(*dict.fromkeys([*key, "split", "sample_id", "record_index", "query", "query_hash", "domain", "model", "pos"])),
        key, _ordered(rows), priority,
    )
    outcomes = dedup.outcomes_by_priority(
        rows.select("sample_id", "dataset", "split", "model", "pos", *OUTCOME_VALUES), ["sample_id", "model"], _ordered(rows), priority
    )
    return _finish(samples, outcomes, complete_only, records)


def ingest_rectangular(records: DataFrame, complete_only: bool = True) -> Pool:
    """Identity is (dataset, split, record index); a query that differs between candidates fails the job."""
    query = F.coalesce(F.nullif(F.col("origin_query"), F.lit("")), F.col("prompt"))
    rows = records.withColumn("query", query).where(~text.is_blank(F.col("query")))
    rows = rows.withColumn("query_hash", text.query_hash(F.col("query"))).withColumn("record_index", F.col("index"))
    rows = rows.withColumn(
        "sample_id", text.sample_id("frozen", F.col("dataset"), F.col("split"), F.col("index"), F.col("query_hash"))
    ).withColumn("domain", text.domain_of(F.col("dataset")))
    key = ["dataset", "split", "record_index"]
    # The conflict check rides on the aggregation that keeps the last row.
    latest = rows.groupBy(*key).agg(
        F.max_by(F.struct("sample_id", "query", "query_hash", "domain"), F.struct("model", "pos")).alias("r"),
        (F.min("query_hash") != F.max("query_hash")).alias("_clash"),
    )
    fail = F.raise_error(F.concat(F.lit("query differs between candidates for "), F.concat_ws("/", *key)))
    # A filter, not a column: it sees every row before incomplete samples are dropped.
    samples = latest.where(F.when(F.col("_clash"), fail.cast("boolean")).otherwise(F.lit(True))).select(*key, "r.*")
    outcomes = dedup.keep_last(
        rows.select("sample_id", "dataset", "split", "model", "pos", *OUTCOME_VALUES), ["sample_id", "model"], [F.col("pos")]
    )
    return _finish(samples, outcomes, complete_only, records)


def ingest_partial(
    records: DataFrame, expected_counts: DataFrame | None = None, index_dataset: str | None = None
) -> tuple[Pool, DataFrame | None]:
    """The cost pool: prompts identify samples, splits collapse by priority, missing cells stay missing.

    Returns the pool and, with expected counts, the audit of samples per dataset.
    `index_dataset` names a dataset that is identified by record index instead.
    """
    by_dataset = {index_dataset: "record_index"} if index_dataset else None
    pool = ingest_generic(records, False, "prompt", by_dataset, True, dedup.SPLIT_PRIORITY)
    audit = audits.dataset_counts(pool.samples, expected_counts) if expected_counts is not None else None
    return pool, audit


def rederive_ids(samples: DataFrame, style: str, index_dataset: str | None = None) -> DataFrame:
    """Add `new_id` by the frozen rule (`indexed`) or the content rule; an invalid digest fails the job."""
    digest = F.lower(F.col("query_hash"))
    fail = F.raise_error(F.concat(F.lit("invalid query_hash in dataset "), F.col("dataset")))
    checked = F.when(text.digest_is_valid(F.col("query_hash")), digest).otherwise(fail)
    parts = (F.col("dataset"), F.col("split"), F.col("record_index"), checked)
    if style == "indexed":
        new = text.sample_id("frozen", *parts)
    else:
        new = F.when(F.col("dataset") == F.lit(index_dataset), text.sample_id("index", *parts)).otherwise(
            text.sample_id("content", *parts)
        )
    return samples.withColumn("new_id", new)


def remap_outcomes(outcomes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace ids by `mapping` (sample_id, new_id); an unknown id fails the job."""
    fail = F.raise_error(F.concat(F.lit("outcome of unknown sample "), F.col("sample_id")))
    rows = outcomes.join(mapping.select("sample_id", "new_id"), "sample_id", "left")
    new = F.when(F.col("new_id").isNull(), fail).otherwise(F.col("new_id"))
    return rows.withColumn("sample_id", new).drop("new_id")
