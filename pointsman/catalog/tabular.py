"""Queries: sources, sinks, projections, joins, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointsman import schemas
from pointsman.catalog import pools
from pointsman.catalog.registry import query
from pointsman.catalog.sql import MODELS, collapse, h, h_text
from pointsman.functions import draws, numeric, text
from pointsman.operators import audits, dedup, features, metrics, paired, routing
from pointsman.plans import ingest
from pointsman.session import scratch_path
from pointsman.sources import results, tables

# ---- result files and records of pool P -----------------------------------------------------

# A file holds at most this many parts, so files grow in number with the data, not in size.
PARTS_PER_FILE = 2000

_RECORDS = f"""rec AS (SELECT s.domain || '-' || CAST(s.key // {PARTS_PER_FILE} AS VARCHAR) AS dataset, x.split, o.model, CAST(s.key AS VARCHAR) AS idx, s.key,
    CASE WHEN s.key % 5 = 0 THEN '  ' ELSE s.query || '  nr ' || CAST(s.key % 50 AS VARCHAR) END AS origin_query,
    CASE WHEN s.key % 35 = 0 THEN NULL ELSE 'Q: ' || s.query || ' nr ' || CAST(s.key % 50 AS VARCHAR) END AS prompt,
    CASE WHEN x.split = 'v1' THEN o.score / 2 ELSE o.score END AS score, o.cost, o.tokens
    FROM p_raw o JOIN p_samples s USING (sample_id), (VALUES ('test_3000'), ('v1')) x(split)
    WHERE (x.split = 'test_3000' AND s.key % 3 <> 0) OR (x.split = 'v1' AND s.key % 3 <> 1))"""


def _records(spark, sf):
    """Two overlapping splits; some texts blank, one field missing, some repeated."""
    rows = pools.p_raw_outcomes(spark, sf).join(pools.p_all_samples(spark, sf), "sample_id")
    key = F.col("key")
    number = (key % 50).cast("string")
    rows = rows.select(
        F.concat(F.col("domain"), F.lit("-"), F.floor(key / PARTS_PER_FILE).cast("string")).alias("dataset"),
        F.explode(F.filter(F.array(F.when(key % 3 != 0, "test_3000"), F.when(key % 3 != 1, "v1")), lambda s: s.isNotNull())).alias("split"),
        "model",
        key.alias("pos"),
        key.cast("string").alias("index"),
        F.when(key % 5 == 0, "  ").otherwise(F.concat("query", F.lit("  nr "), number)).alias("origin_query"),
        F.when(key % 35 != 0, F.concat(F.lit("Q: "), "query", F.lit(" nr "), number)).alias("prompt"),
        "score",
        "cost",
        F.col("tokens").alias("prompt_tokens"),
        F.lit(0).cast("long").alias("completion_tokens"),
    )
    return rows.withColumn("score", F.when(F.col("split") == "v1", F.col("score") / 2).otherwise(F.col("score")))


def _write_result_files(spark, sf, root):
    """One JSON object per (dataset, split, candidate); a dataset has a bounded number of parts."""
    rows = _records(spark, sf)
    record = F.struct("index", "origin_query", "prompt", "score", "cost", "prompt_tokens", "completion_tokens")
    files = rows.groupBy("dataset", "split", "model").agg(F.collect_list(record).alias("records"))
    files.select(
        F.col("dataset").alias("d"), F.col("split").alias("s"), F.col("model").alias("m"),
        # Every third candidate's files lack their header, so ids must come from the path.
        F.when(~F.col("model").isin("m3", "m6"), F.col("dataset")).alias("dataset_name"),
        "split", F.col("model").alias("model_name"), F.lit(False).alias("demo"), "records",
    ).write.partitionBy("d", "s", "m").json(root)


@query(
    "scan_result_json",
    "dataset s, split s, model s, index s, score 6, cost 4, prompt_tokens i",
    f'WITH {_RECORDS} SELECT dataset, split, model, idx AS "index", score, cost, tokens AS prompt_tokens FROM rec',
)
def scan_result_json(spark, sf):
    root = scratch_path(spark, "results")
    _write_result_files(spark, sf, root)
    return results.load_records(spark, root)


@query(
    "explode_records",
    "dataset s, model s, pos i, index s, score 6",
    """WITH r AS (SELECT p_brand AS dataset, 'm' || l_linenumber AS model, l_partkey, l_orderkey, l_discount,
         row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey, l_extendedprice, l_discount) - 1 AS pos
         FROM lineitem JOIN part ON p_partkey = l_partkey)
       SELECT dataset || '/' || CAST(l_partkey AS VARCHAR) AS dataset, model, pos, CASE WHEN l_orderkey % 4 = 0 THEN CAST(pos AS VARCHAR) ELSE CAST(l_orderkey AS VARCHAR) END AS "index",
         CASE WHEN l_orderkey % 6 = 0 THEN 0 ELSE round(l_discount * 100) / 10 END AS score FROM r""",
)
def explode_records(spark, sf):
    """Record arrays of a few lines each; some records lack an index or a score."""
    rows = pools.table(spark, sf, "lineitem").join(pools.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    key = F.col("l_orderkey")
    record = F.struct(
        F.when(key % 4 != 0, key.cast("string")).alias("index"),
        F.lit(None).cast("string").alias("origin_query"),
        F.lit(None).cast("string").alias("prompt"),
        F.when(key % 6 != 0, (F.round(F.col("l_discount") * 100) / 10).cast("string")).alias("score"),
        F.lit(None).cast("string").alias("cost"),
        F.lit(None).cast("string").alias("prompt_tokens"),
        F.lit(None).cast("string").alias("completion_tokens"),
    )
    placed = F.struct(key, "l_suppkey", "l_extendedprice", "l_discount", record.alias("r"))
    files = rows.groupBy("p_brand", "l_partkey", "l_linenumber").agg(F.array_sort(F.collect_list(placed)).alias("a"))
    return results.explode_records(
        files.select(
            F.lit("").alias("path"),
            F.concat("p_brand", F.lit("/"), F.col("l_partkey").cast("string")).alias("dataset"),
            F.lit("test").alias("split"),
            F.concat(F.lit("m"), "l_linenumber").alias("model"),
            F.transform("a", lambda s: s["r"]).alias("records"),
        )
    )


def _file_rows(spark, sf):
    """One would-be file per order line."""
    li = pools.table(spark, sf, "lineitem")
    name = F.when(F.col("l_linenumber") == 3, F.lit("result.json")).otherwise(
        F.concat(F.lit("run_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("_"), F.lpad((F.col("l_suppkey") % 240000).cast("string"), 6, "0"), F.lit(".json"))
    )
    return li.select(
        F.concat(F.lit("Data-Set "), F.col("l_partkey").cast("string")).alias("dataset"),
        F.col("l_returnflag").alias("split"),
        F.concat(F.lit("m"), "l_linenumber").alias("model"),
        (F.col("l_orderkey") % 10 == 0).alias("demo"),
        F.concat_ws("/", F.lit("/data"), F.col("l_orderkey").cast("string"), name).alias("path"),
    )


_FILES = """fl AS (SELECT 'Data-Set ' || CAST(l_partkey AS VARCHAR) AS dataset, l_returnflag AS split, 'm' || l_linenumber AS model, l_orderkey % 10 = 0 AS demo,
    '/data/' || CAST(l_orderkey AS VARCHAR) || '/' || CASE WHEN l_linenumber = 3 THEN 'result.json' ELSE 'run_' || strftime(l_shipdate, '%Y%m%d') || '_' || lpad(CAST(l_suppkey % 240000 AS VARCHAR), 6, '0') || '.json' END AS path,
    CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(strftime(l_shipdate, '%Y%m%d') || lpad(CAST(l_suppkey % 240000 AS VARCHAR), 6, '0') AS BIGINT) END AS ts FROM lineitem)"""


@query(
    "filter_pool",
    "dataset s, split s, model s, path s",
    f"WITH {_FILES} SELECT dataset, split, model, path FROM fl WHERE NOT demo AND model IN ('m1', 'm3') AND split IN ('A', 'N') AND dataset IN ('Data-Set 17', 'Data-Set 4', 'Data-Set 99')",
)
def filter_pool(spark, sf):
    wanted = {"data set 17", " DATA_SET-4", "data__set_99"}
    return results.filter_pool(_file_rows(spark, sf), wanted, {"m1", " m3"}, {"A", "N"})


@query(
    "latest_artifact",
    "dataset s, split s, model s, path s",
    f"WITH {_FILES} SELECT dataset, split, model, path FROM (SELECT *, row_number() OVER (PARTITION BY dataset, split, model ORDER BY ts DESC, path DESC) AS rn FROM fl) WHERE rn = 1",
)
def latest_artifact(spark, sf):
    return results.latest_artifact(_file_rows(spark, sf))


@query("latest_artifact_lexical", "dataset s, split s, model s, path s", f"WITH {_FILES} SELECT dataset, split, model, max(path) AS path FROM fl GROUP BY ALL")
def latest_artifact_lexical(spark, sf):
    return results.latest_artifact(_file_rows(spark, sf), lexical=True)


@query("filename_timestamp", "path s, ts i", f"WITH {_FILES} SELECT path, ts FROM fl")
def filename_timestamp(spark, sf):
    return _file_rows(spark, sf).select("path", text.filename_timestamp(F.col("path")).alias("ts"))


_IDENT = f"""{_RECORDS}, idn AS (SELECT *, CASE WHEN trim(coalesce(prompt, '')) <> '' THEN prompt WHEN trim(coalesce(origin_query, '')) <> '' THEN origin_query END AS q_prompt,
    CASE WHEN trim(coalesce(origin_query, '')) <> '' THEN origin_query WHEN trim(coalesce(prompt, '')) <> '' THEN prompt END AS q_origin FROM rec)"""


@query(
    "pick_identity_text",
    "model s, split s, index s, by_prompt s, by_origin s",
    f'WITH {_IDENT} SELECT model, split, idx AS "index", q_prompt AS by_prompt, q_origin AS by_origin FROM idn WHERE q_prompt IS NOT NULL OR q_origin IS NOT NULL',
)
def pick_identity_text(spark, sf):
    rows = _records(spark, sf)
    prompt, origin = F.col("prompt"), F.col("origin_query")
    return rows.select(
        "model", "split", "index",
        text.identity_text(prompt, origin, "prompt").alias("by_prompt"),
        text.identity_text(prompt, origin, "origin_query").alias("by_origin"),
    ).where("by_prompt is not null or by_origin is not null")


_GENERIC = f"""{_IDENT}, g AS (SELECT *, sha256({collapse("q_origin")}) AS qh FROM idn WHERE q_origin IS NOT NULL),
    gs AS (SELECT *, dataset || ':' || split || ':' || substr(qh, 1, 16) AS sample_id FROM g),
    smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, split, qh ORDER BY model, key) AS rn FROM gs) WHERE rn = 1),
    otc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, model ORDER BY key DESC) AS rn FROM gs) WHERE rn = 1),
    keep AS (SELECT sample_id FROM otc GROUP BY sample_id HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM otc))"""
_POOL_SPEC = "sample_id s, record_index s, query s, query_hash s, domain s, model s, split s, score 6, cost 4, prompt_tokens i"


def _pool_rows(pool):
    return pool.samples.select("sample_id", "record_index", "query", "query_hash", "domain").join(pool.outcomes, "sample_id")


@query(
    "ingest_generic",
    _POOL_SPEC,
    f"""WITH {_GENERIC} SELECT s.sample_id, s.idx AS record_index, s.q_origin AS query, s.qh AS query_hash, 'unknown' AS domain, o.model, o.split, o.score, o.cost, o.tokens AS prompt_tokens
        FROM smp s JOIN otc o USING (sample_id) WHERE s.sample_id IN (SELECT sample_id FROM keep)""",
)
def ingest_generic(spark, sf):
    return _pool_rows(ingest.ingest_generic(_records(spark, sf)))


@query(
    "ingest_rectangular",
    _POOL_SPEC,
    f"""WITH {_RECORDS}, r AS (SELECT *, CASE WHEN coalesce(origin_query, '') <> '' THEN origin_query ELSE prompt END AS q FROM rec),
        r2 AS (SELECT *, sha256({collapse("q")}) AS qh FROM r WHERE trim(coalesce(q, '')) <> ''),
        r3 AS (SELECT *, dataset || ':' || split || ':' || idx || ':' || substr(qh, 1, 12) AS sample_id FROM r2),
        keep AS (SELECT sample_id FROM r3 GROUP BY sample_id HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM r3))
        SELECT sample_id, idx AS record_index, q AS query, qh AS query_hash, 'unknown' AS domain, model, split, score, cost, tokens AS prompt_tokens FROM r3 WHERE sample_id IN (SELECT sample_id FROM keep)""",
)
def ingest_rectangular(spark, sf):
    return _pool_rows(ingest.ingest_rectangular(_records(spark, sf)))


_PARTIAL = f"""{_IDENT}, g AS (SELECT *, sha256({collapse("q_prompt")}) AS qh, CASE split WHEN 'test_3000' THEN 5 WHEN 'v1' THEN 2 ELSE 0 END AS rank_ FROM idn WHERE q_prompt IS NOT NULL),
    gs AS (SELECT *, CASE WHEN dataset LIKE 'ECONOMY-%' THEN 'idx:' || idx ELSE qh END AS unit,
      CASE WHEN dataset = 'ECONOMY-0' THEN dataset || ':idx:' || idx ELSE dataset || ':' || substr(qh, 1, 16) END AS sample_id FROM g),
    gu AS (SELECT * EXCLUDE (unit), CASE WHEN dataset = 'ECONOMY-0' THEN 'idx:' || idx ELSE qh END AS unit FROM gs),
    smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, unit ORDER BY rank_ DESC, split, model, key) AS rn FROM gu) WHERE rn = 1),
    otc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, model ORDER BY rank_ DESC, split DESC, key DESC) AS rn FROM gu) WHERE rn = 1)"""


@query(
    "ingest_partial",
    _POOL_SPEC,
    f"""WITH {_PARTIAL} SELECT s.sample_id, s.idx AS record_index, s.q_prompt AS query, s.qh AS query_hash, 'unknown' AS domain, o.model, o.split, o.score, o.cost, o.tokens AS prompt_tokens
        FROM smp s JOIN otc o USING (sample_id)""",
)
def ingest_partial(spark, sf):
    pool, _ = ingest.ingest_partial(_records(spark, sf), index_dataset="economy_0")
    return _pool_rows(pool)


@query(
    "normalize_name",
    "raw s, name s",
    r"""WITH n AS (SELECT DISTINCT ' ' || p_brand || '  ' || p_type || '-X' AS raw FROM part UNION ALL SELECT * FROM (VALUES ('SWE-bench'), (' Tau²-Bench '), ('MMLU_Pro'), ('__A--b  C_')) v(raw))
       SELECT raw, CASE raw WHEN 'SWE-bench' THEN 'swe_bench' WHEN ' Tau²-Bench ' THEN 'tau2' WHEN 'MMLU_Pro' THEN 'mmlupro' WHEN '__A--b  C_' THEN 'a_b_c'
         ELSE trim(regexp_replace(regexp_replace(lower(trim(raw)), '[\s-]+', '_', 'g'), '_+', '_', 'g'), '_') END AS name FROM n""",
)
def normalize_name(spark, sf):
    part = pools.table(spark, sf, "part").select(F.concat(F.lit(" "), "p_brand", F.lit("  "), "p_type", F.lit("-X")).alias("raw")).distinct()
    few = spark.createDataFrame([("SWE-bench",), (" Tau²-Bench ",), ("MMLU_Pro",), ("__A--b  C_",)], "raw string")
    return part.unionByName(few).select("raw", text.normalize_name(F.col("raw")).alias("name"))


_NAMES = ["aime", "SWE-Bench", "mmlu pro", "kandk", "meld", "arena hard", "Tau2-bench", "other"]
_DOMAINS = ["math", "code", "knowledge", "logic", "affective", "instruction_following", "tool_use", "unknown"]


@query(
    "assign_domain",
    "sample_id s, dataset s, domain s",
    f"SELECT sample_id, [{', '.join(repr(n) for n in _NAMES)}][key % 8 + 1] AS dataset, [{', '.join(repr(n) for n in _DOMAINS)}][key % 8 + 1] AS domain FROM p_samples",
)
def assign_domain(spark, sf):
    name = F.array(*[F.lit(n) for n in _NAMES])[(F.col("key") % 8).cast("int")]
    rows = pools.p_all_samples(spark, sf).select("sample_id", name.alias("dataset"))
    return rows.withColumn("domain", text.domain_of(F.col("dataset")))


@query(
    "make_sample_id",
    "key i, content s, content_split s, by_index s, index_split s, frozen s, valid b",
    f"""SELECT key, dataset || ':' || substr(d, 1, 16) AS content, dataset || ':' || domain || ':' || substr(d, 1, 16) AS content_split, dataset || ':idx:' || sample_id AS by_index,
        dataset || ':' || domain || ':idx:' || sample_id AS index_split, dataset || ':' || domain || ':' || sample_id || ':' || substr(d, 1, 12) AS frozen,
        key % 9 <> 0 AS valid FROM (SELECT *, sha256({collapse("query")}) AS d FROM p_samples)""",
)
def make_sample_id(spark, sf):
    rows = pools.p_all_samples(spark, sf).withColumn("d", text.query_hash(F.col("query")))
    parts = (F.col("dataset"), F.col("domain"), F.col("sample_id"), F.col("d"))
    named = {"content": "content", "content_split": "content_split", "index": "by_index", "index_split": "index_split", "frozen": "frozen"}
    damaged = F.when(F.col("key") % 9 == 0, F.substring("d", 1, 63)).otherwise(F.upper("d"))
    return rows.select("key", *[text.sample_id(r, *parts).alias(n) for r, n in named.items()], text.digest_is_valid(damaged).alias("valid"))


@query(
    "remap_ids",
    "sample_id s, model s, score 6",
    f"SELECT s.dataset || ':' || substr(sha256({collapse('s.query')} || '#' || s.sample_id), 1, 16) AS sample_id, model, score FROM p_raw JOIN p_samples s USING (sample_id)",
)
def remap_ids(spark, sf):
    samples = pools.p_all_samples(spark, sf)
    digest = text.query_hash(F.concat(text.collapse_ws(F.col("query")), F.lit("#"), F.col("sample_id")))
    renamed = ingest.rederive_ids(
        samples.select("sample_id", "dataset", F.lit("").alias("split"), F.col("sample_id").alias("record_index"), digest.alias("query_hash")), "content"
    )
    known = pools.p_raw_outcomes(spark, sf).join(samples, "sample_id", "left_semi")
    return ingest.remap_outcomes(known, renamed)


# ---- tables in and out ---------------------------------------------------------------------------


@query(
    "scan_decision_jsonl",
    "sample_id s, n_answers i, input_tokens i, latency_ms 4, noul 6, masses s",
    """SELECT sample_id, 17 AS n_answers, 100 + key % 500 AS input_tokens, CAST(key * 7 % 1000 AS DOUBLE) / 4 AS latency_ms,
         CAST((key * 3 + size) % 11 AS DOUBLE) / 10 AS noul, CASE WHEN true THEN 'array' END AS masses FROM ps""",
)
def scan_decision_jsonl(spark, sf):
    """Written as JSON lines in two files, of which the later holds a second answer for some samples."""
    path = scratch_path(spark, "decisions")
    rows = pools.p_decisions(pools.p_samples(spark, sf))
    old = rows.where(F.length("sample_id") % 2 == 0).withColumn("latency_ms", F.lit(-1.0))
    old.write.json(f"{path}/0-old")
    rows.write.json(f"{path}/1-new")
    last = tables.last_decisions(tables.scan_decisions(spark, f"{path}/*"))
    return last.select(
        "sample_id",
        F.size("answers").alias("n_answers"),
        F.col("usage.input_tokens").alias("input_tokens"),
        "latency_ms",
        F.col("answers.math_reasoning.noul").alias("noul"),
        F.when(F.col("answers.reasoning_depth.probabilities").startswith("["), "array").otherwise("object").alias("masses"),
    )


@query(
    "scan_csv_tables",
    "sample_id s, dataset s, query s, n_chars i",
    "SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang AS dataset, sha256(text) AS query, length(text) AS n_chars FROM documents",
)
def scan_csv_tables(spark, sf):
    """Whole texts with quotes and line breaks, through CSV and back."""
    path = scratch_path(spark, "csv")
    docs = pools.d_samples(spark, sf)
    empty = F.lit(None).cast("string")
    shaped = docs.select("sample_id", "dataset", *[empty.alias(c) for c in ("split", "record_index")], "query", empty.alias("query_hash"), "domain")
    tables.sink_csv(shaped, path)
    back = tables.scan_csv(spark, path, schemas.SAMPLES)
    return back.select("sample_id", "dataset", F.sha2("query", 256).alias("query"), F.length("query").alias("n_chars"))


@query(
    "scan_jsonl",
    "sample_id s, dataset s, digest s",
    "SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang AS dataset, sha256(text) AS digest FROM documents",
)
def scan_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    tables.sink_jsonl(pools.d_samples(spark, sf).select("sample_id", "dataset", "query"), path)
    back = tables.scan_jsonl(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "dataset", "query")]))
    return back.select("sample_id", "dataset", F.sha2("query", 256).alias("digest"))


@query(
    "sink_jsonl",
    "line s",
    """SELECT '{"cost":' || CAST(CAST(key AS BIGINT) AS VARCHAR) || ',"dataset":"' || dataset || '","note":null,"sample_id":"' || sample_id || '"}' AS line FROM p_samples""",
)
def sink_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    rows = pools.p_all_samples(spark, sf).select("sample_id", F.lit(None).cast("string").alias("note"), "dataset", F.col("key").alias("cost"))
    tables.sink_jsonl(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "scan_embeddings",
    "sample_id s, dim i, norm 5, first 6",
    "SELECT CAST(vec_id AS VARCHAR) AS sample_id, len(embedding) AS dim, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS norm, embedding[1] AS first FROM embeddings",
)
def scan_embeddings(spark, sf):
    rows = tables.embedding_vectors(pools.table(spark, sf, "embeddings"), "vec_id")
    return rows.select(
        "sample_id", F.size("x").alias("dim"), F.sqrt(numeric.total(F.transform("x", lambda v: v * v))).alias("norm"), F.col("x")[0].alias("first")
    )


@query("artifact_hash_inventory", "path s, length i, sha256 s")
def artifact_hash_inventory(spark, sf):
    """Hashes of files written from the part table, one per candidate of brands."""
    path = scratch_path(spark, "artifacts")
    pools.p_all_samples(spark, sf).repartition(4, "dataset").write.json(path)
    return tables.file_hashes(spark, path).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "length", "sha256")


@query(
    "sink_run_artifacts",
    "experiment s, seed i, system s, n_rows i, avg_score 8",
    "SELECT 'main' AS experiment, seed, system, count(*) AS n_rows, avg(selected_score) AS avg_score FROM pk GROUP BY ALL",
)
def sink_run_artifacts(spark, sf):
    path = scratch_path(spark, "runs")
    picks = routing.selected(pools.all_predictions(pools.p_frame(spark, sf)), MODELS).withColumn("experiment", F.lit("main"))
    tables.sink_runs(picks, path)
    tables.sink_runs(picks.where("seed = 1").withColumn("experiment", F.lit("other")), path)
    return tables.scan_runs(spark, path, "main").groupBy("experiment", "seed", "system").agg(
        F.count("*").alias("n_rows"), F.avg("selected_score").alias("avg_score")
    )


@query(
    "concat_prediction_runs",
    "sample_id s, dataset s, selected_score 6",
    "SELECT sample_id, dataset, selected_score FROM pk WHERE seed = 1 AND system = 'alpha'",
)
def concat_prediction_runs(spark, sf):
    """One run per domain, written apart, read as one table without repeats."""
    path = scratch_path(spark, "holdouts")
    picks = routing.selected(pools.with_predictions(pools.p_frame(spark, sf)).drop("pred_cost"), MODELS)
    picks.write.partitionBy("domain").parquet(path)
    return tables.unique_predictions(spark.read.parquet(path))


# ---- joins, sorts and sets -----------------------------------------------------------------------------


def _alpha(spark, sf):
    return routing.selected(pools.with_predictions(pools.p_frame(spark, sf)).drop("pred_cost"), MODELS)


@query(
    "join_predictions_dataset",
    "sample_id s, dataset s, selected_score 6",
    "SELECT sample_id, dataset, selected_score FROM pk WHERE seed = 1 AND system = 'alpha'",
)
def join_predictions_dataset(spark, sf):
    return metrics.attach_dataset(_alpha(spark, sf).select("sample_id", "selected_score"), pools.p_all_samples(spark, sf))


@query(
    "join_paired_predictions",
    "sample_id s, dataset s, leakage_group s, score_a 6, score_b 6, diff 6",
    "SELECT sample_id, dataset, leakage_group, score_a, score_b, diff FROM pd",
)
def join_paired_predictions(spark, sf):
    frame = pools.p_frame(spark, sf)
    b = routing.selected(pools.with_predictions(frame, 1, "beta").drop("pred_cost"), MODELS)
    return paired.paired_frame(frame, _alpha(spark, sf), b, grouped=True)


@query(
    "join_features_ordered",
    "sample_id s, feature s, value 8",
    "SELECT sample_id, feature, value FROM pm JOIN ps USING (sample_id)",
)
def join_features_ordered(spark, sf):
    samples = pools.p_samples(spark, sf)
    fs = pools.p_mass(samples)
    ids = samples.select("sample_id")
    return features.FeatureSet(features.join_features(ids, fs), fs.names).long()


@query(
    "join_features_semantic_left",
    "sample_id s, det_size i, n_features i",
    "SELECT s.sample_id, s.size AS det_size, CASE WHEN r.sample_id IS NULL THEN 0 ELSE 40 END AS n_features FROM p_samples s LEFT JOIN p_ids r USING (sample_id)",
)
def join_features_semantic_left(spark, sf):
    """Samples without features stay, with none."""
    base = pools.p_all_samples(spark, sf)
    fs = pools.p_mass(pools.p_samples(spark, sf))
    rows = features.join_features(base.select("sample_id", F.col("size").alias("det_size")), fs, required=False)
    return rows.select("sample_id", "det_size", F.coalesce(F.size(F.filter("x", lambda v: v.isNotNull())), F.lit(0)).alias("n_features"))


@query(
    "join_embeddings_required",
    "sample_id s, first 6, n_beyond i",
    """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, embedding[1] AS first FROM embeddings), d AS (SELECT sample_id, CAST(sample_id AS BIGINT) <= (SELECT max(vec_id) FROM embeddings) AS own FROM d_out WHERE model = 'quality')
       SELECT sample_id, first, (SELECT count(*) FROM d WHERE NOT own) AS n_beyond FROM d LEFT JOIN e USING (sample_id) WHERE own""",
)
def join_embeddings_required(spark, sf):
    """Every labelled document up to the last vector must have one; a gap would fail the job."""
    ids = pools.d_frame(spark, sf).select("sample_id", pools.has_vector(spark, sf).alias("own"))
    beyond = ids.agg(F.count_if(~F.col("own")).alias("n_beyond"))
    joined = tables.join_vectors(ids.where("own").select("sample_id"), pools.d_vectors(spark, sf))
    return joined.select("sample_id", F.col("x")[0].alias("first")).join(F.broadcast(beyond))


@query("anti_resume_pending", "sample_id s", "SELECT sample_id FROM p_samples WHERE sample_id NOT IN (SELECT sample_id FROM p_ids)")
def anti_resume_pending(spark, sf):
    from pointsman.operators import enrich

    return enrich.pending(pools.p_all_samples(spark, sf), pools.p_samples(spark, sf))


@query("head_limit", "sample_id s", "SELECT sample_id FROM p_samples WHERE sample_id NOT IN (SELECT sample_id FROM p_ids) ORDER BY sample_id LIMIT 25")
def head_limit(spark, sf):
    from pointsman.operators import enrich

    return enrich.pending(pools.p_all_samples(spark, sf), pools.p_samples(spark, sf), limit=25)


@query("show_row", "sample_id s, dataset s, query s", "SELECT sample_id, dataset, query FROM p_samples ORDER BY sample_id LIMIT 1 OFFSET 100")
def show_row(spark, sf):
    return pools.p_all_samples(spark, sf).orderBy("sample_id").offset(100).limit(1)


@query("sort_export", "sample_id s, model s, score 6", "SELECT sample_id, model, score FROM p_raw ORDER BY sample_id, model")
def sort_export(spark, sf):
    return tables.sorted_export(pools.p_raw_outcomes(spark, sf), ["sample_id", "model"])


@query(
    "union_folds",
    "sample_id s, fold i, selected_score 6",
    f"SELECT sample_id, {h(chr(39) + 'f' + chr(39), 'sample_id')} % 3 AS fold, selected_score FROM pk WHERE seed = 1 AND system = 'alpha'",
)
def union_folds(spark, sf):
    """Folds predicted apart, united, each sample exactly once."""
    rows = _alpha(spark, sf).withColumn("fold", draws.hash_int("f", F.col("sample_id")) % 3)
    parts = [rows.where(F.col("fold") == k) for k in range(3)]
    return tables.unique_predictions(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "union_train_test",
    "sample_id s, partition s",
    "SELECT sample_id, 'train' AS partition FROM p_ids UNION ALL SELECT sample_id, 'test' FROM p_samples WHERE sample_id NOT IN (SELECT sample_id FROM p_ids)",
)
def union_train_test(spark, sf):
    train = pools.p_samples(spark, sf).select("sample_id")
    test = pools.p_all_samples(spark, sf).select("sample_id").join(train, "sample_id", "left_anti")
    return train.withColumn("partition", F.lit("train")).unionByName(test.withColumn("partition", F.lit("test")))


@query(
    "support_equality",
    "side s, sample_id s",
    """(SELECT 'left_only' AS side, sample_id FROM o_samples WHERE sample_id NOT IN (SELECT sample_id FROM oo) ORDER BY sample_id LIMIT 10)
       UNION ALL (SELECT 'right_only' AS side, sample_id FROM oo WHERE sample_id NOT IN (SELECT sample_id FROM o_samples) GROUP BY sample_id ORDER BY sample_id LIMIT 10)""",
)
def support_equality(spark, sf):
    return audits.set_difference(pools.o_samples(spark, sf), pools.o_outcomes(spark, sf))


@query(
    "support_digest",
    "seed i, system s, n_ids i, digest_0 i, digest_1 i",
    """SELECT seed, system, count(*) AS n_ids, bit_xor(CAST(('0x' || substr(md5(sample_id), 1, 8)) AS BIGINT)) AS digest_0,
       bit_xor(CAST(('0x' || substr(md5(sample_id), 9, 8)) AS BIGINT)) AS digest_1 FROM pk WHERE system <> 'gamma' OR selected_score > 0.5 GROUP BY ALL""",
)
def support_digest(spark, sf):
    picks = routing.selected(pools.all_predictions(pools.p_frame(spark, sf)), MODELS)
    return metrics.support_digest(picks.where("system <> 'gamma' or selected_score > 0.5"), ("seed", "system"))


# ---- scalar functions ------------------------------------------------------------------------------------


@query("query_hash", "sample_id s, query_hash s", f"SELECT sample_id, sha256({collapse('query')}) AS query_hash FROM d_samples")
def query_hash(spark, sf):
    return pools.d_samples(spark, sf).select("sample_id", text.query_hash(F.col("query")).alias("query_hash"))


@query(
    "leakage_group",
    "sample_id s, leakage_group s, copies i",
    f"""SELECT sample_id, g AS leakage_group, count(*) OVER (PARTITION BY g) AS copies FROM (SELECT sample_id, sha256(dataset || chr(0) || {collapse('query')}) AS g FROM d_samples)""",
)
def leakage_group(spark, sf):
    rows = pools.d_samples(spark, sf).select("sample_id", text.leakage_group(F.col("dataset"), F.col("query")).alias("leakage_group"))
    return rows.join(rows.groupBy("leakage_group").agg(F.count("*").alias("copies")), "leakage_group")


@query(
    "canonical_json_hash",
    "sample_id s, digest s",
    """SELECT sample_id, sha256('{"dataset":"' || dataset || '","key":' || CAST(key AS VARCHAR) || ',"none":null,"query":"' || query || '"}') AS digest FROM p_samples""",
)
def canonical_json_hash(spark, sf):
    digest = text.canonical_json_hash(query=F.col("query"), key=F.col("key"), none=F.lit(None).cast("string"), dataset=F.col("dataset"))
    return pools.p_all_samples(spark, sf).select("sample_id", digest.alias("digest"))


@query(
    "stable_seed",
    "sample_id s, seed i",
    """SELECT sample_id, CAST(((CAST(('0x' || substr(d, 1, 8)) AS HUGEINT) * 4294967296 + CAST(('0x' || substr(d, 9, 8)) AS HUGEINT)) % 2147483647) AS BIGINT) AS seed
       FROM (SELECT sample_id, sha256('[3407,"' || query || '",' || CAST(key AS VARCHAR) || ']') AS d FROM p_samples)""",
)
def stable_seed(spark, sf):
    return pools.p_all_samples(spark, sf).select("sample_id", draws.stable_seed(3407, F.col("query"), F.col("key")).alias("seed"))


@query(
    "half_even_round",
    "n i, half i, share i",
    "SELECT n, CAST(round_even(n / 2.0::DOUBLE, 0) AS BIGINT) AS half, CASE WHEN n > 1 THEN greatest(1, least(n - 1, CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT))) ELSE 1 END AS share FROM (SELECT DISTINCT size AS n FROM p_samples WHERE size > 0)",
)
def half_even_round(spark, sf):
    n = F.col("n")
    rows = pools.p_all_samples(spark, sf).select(F.col("size").alias("n")).where("n > 0").distinct()
    return rows.select("n", numeric.half_even(n / 2).alias("half"), numeric.clamped_share(n, 0.7).alias("share"))


@query(
    "clean_numeric",
    "sample_id s, value 6",
    "SELECT sample_id, CASE WHEN key % 4 = 3 THEN CAST(key AS DOUBLE) / 8 ELSE 0 END AS value FROM p_samples",
)
def clean_numeric(spark, sf):
    k = F.col("key")
    raw = (
        F.when(k % 4 == 0, F.lit(float("inf"))).when(k % 4 == 1, F.lit(float("nan"))).when(k % 4 == 3, k.cast("double") / 8)
    )
    return pools.p_all_samples(spark, sf).select("sample_id", numeric.clean_numeric(raw).alias("value"))


@query(
    "minmax_columnwise",
    "sample_id s, model s, value 8",
    """SELECT sample_id, model, (q - l) / CASE WHEN u > l THEN u - l ELSE 1 END AS value FROM pr JOIN (SELECT model, min(q) AS l, max(q) AS u FROM pr WHERE seed = 1 AND system = 'alpha' GROUP BY model) USING (model)
       WHERE seed = 1 AND system = 'alpha'""",
)
def minmax_columnwise(spark, sf):
    frame = pools.with_predictions(pools.p_frame(spark, sf))
    bounds = routing.candidate_bounds(frame, ["pred"], len(MODELS))
    scaled = F.transform("pred", lambda v, i: numeric.minmax(v, F.get("pred_low", i), F.get("pred_high", i)))
    rows = frame.join(F.broadcast(bounds)).select("sample_id", F.posexplode(scaled).alias("i", "value"))
    return rows.select("sample_id", routing.name_at(MODELS, F.col("i") + 1).alias("model"), "value")


@query(
    "minmax_global",
    "sample_id s, model s, value 8",
    """SELECT sample_id, model, (q - l) / greatest(u - l, 1e-12) AS value FROM pr, (SELECT min(q) AS l, max(q) AS u FROM pr WHERE seed = 1 AND system = 'alpha') WHERE seed = 1 AND system = 'alpha'""",
)
def minmax_global(spark, sf):
    frame = pools.with_predictions(pools.p_frame(spark, sf))
    bounds = routing.global_bounds(frame, ["pred"])
    rows = frame.select("sample_id", F.posexplode(routing.scaled_globally("pred", bounds)).alias("i", "value"))
    return rows.select("sample_id", routing.name_at(MODELS, F.col("i") + 1).alias("model"), "value")


@query(
    "quality_cost_utility",
    "sample_id s, model s, utility 8",
    "SELECT sample_id, model, 0.75 * q - 0.25 * greatest(0, c - 1000) AS utility FROM pr WHERE seed = 1 AND system = 'alpha'",
)
def quality_cost_utility(spark, sf):
    frame = pools.with_predictions(pools.p_frame(spark, sf))
    money = F.transform("pred_cost", lambda v: F.greatest(F.lit(0.0), v - 1000))
    rows = frame.select("sample_id", F.posexplode(routing.utilities(F.col("pred"), money, F.lit(0.25))).alias("i", "utility"))
    return rows.select("sample_id", routing.name_at(MODELS, F.col("i") + 1).alias("model"), "utility")


@query(
    "safe_relative",
    "sample_id s, gain 8, gap 8",
    "SELECT sample_id, CASE WHEN abs(b) > 1e-12 THEN a / b - 1 END AS gain, CASE WHEN abs(b) > 1e-12 THEN 1 - a / b END AS gap FROM (SELECT sample_id, CAST(key AS DOUBLE) AS a, CAST(size % 3 AS DOUBLE) AS b FROM p_samples)",
)
def safe_relative(spark, sf):
    a, b = F.col("key").cast("double"), (F.col("size") % 3).cast("double")
    return pools.p_all_samples(spark, sf).select(
        "sample_id", numeric.safe_relative(a, b).alias("gain"), numeric.safe_relative(a, b, one_minus=True).alias("gap")
    )


del dedup, h_text
