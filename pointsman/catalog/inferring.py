"""Queries: paired inference, release checks and enrichment."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pointsman.catalog import pools
from pointsman.catalog.pools import BACKEND
from pointsman.catalog.registry import query
from pointsman.catalog.sql import MODELS, collapse, h, mixed, unit
from pointsman.operators import enrich, paired, routing
from pointsman.plans import checks
from pointsman.session import scratch_path, summary

#: The operators' own numbers of draws; a test of non-inferiority takes more.
BOOT, PERM, BOUND, SEED = 5_000, 10_000, 10_000, 3407


def _sides(spark, sf, seed=1):
    frame = pools.p_frame(spark, sf).persist()
    a = routing.selected(pools.with_predictions(frame, seed, "alpha").drop("pred_cost"), MODELS)
    b = routing.selected(pools.with_predictions(frame, seed, "beta").drop("pred_cost"), MODELS)
    return frame, a, b


def _frame(spark, sf, grouped=False):
    return paired.paired_frame(*_sides(spark, sf), grouped=grouped).persist()


def _units(grouped: bool, source: str = "pd") -> str:
    if grouped:
        return f"SELECT dataset, leakage_group AS unit, sum(diff) AS total, count(*) AS size FROM {source} GROUP BY dataset, leakage_group"
    return f"SELECT dataset, sample_id AS unit, diff AS total, 1 AS size FROM {source}"


def _boot(grouped: bool, source: str = "pd", seed: int = SEED, n: int = BOOT, tag: str = "") -> str:
    return f"""un{tag} AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5(unit)) - 1 AS slot FROM ({_units(grouped, source)})),
      nn{tag} AS (SELECT dataset, count(*) AS n FROM un{tag} GROUP BY dataset),
      ky{tag} AS (SELECT b.b AS replicate, dataset, n, {h(str(seed), 'b.b', 'dataset')} AS key FROM nn{tag}, range(0, {n}) b(b)),
      dr{tag} AS (SELECT replicate, dataset, {mixed('key', 'slot')} % n AS slot FROM ky{tag} JOIN un{tag} USING (dataset)),
      rep{tag} AS (SELECT replicate, avg(m) AS macro FROM (SELECT replicate, dataset, sum(total) / sum(size) AS m FROM dr{tag} JOIN un{tag} USING (dataset, slot) GROUP BY replicate, dataset) GROUP BY replicate),
      ci{tag} AS (SELECT quantile_cont(macro, 0.025) AS lo, quantile_cont(macro, 0.975) AS hi, quantile_cont(macro, 0.05) AS one FROM rep{tag})"""


def _perm(grouped: bool, source: str = "pd", seed: int = SEED, n: int = PERM, tag: str = "") -> str:
    weight = f"1.0::DOUBLE / ((SELECT count(DISTINCT dataset) FROM {source}) * count(*) OVER (PARTITION BY dataset))"
    unit = "leakage_group" if grouped else "sample_id"
    return f"""cw{tag} AS (SELECT dataset, {unit} AS unit, sum(c) AS c FROM (SELECT *, diff * {weight} AS c FROM {source}) GROUP BY ALL),
      ob{tag} AS (SELECT avg(m) AS macro FROM (SELECT avg(diff) AS m FROM {source} GROUP BY dataset)),
      sg{tag} AS (SELECT t.b * 32 + bit.i AS p, sum(CASE WHEN (w >> bit.i) & 1 = 1 THEN c ELSE -c END) AS stat
        FROM (SELECT b.b, c, {h(str(seed), 'b.b', 'unit')} AS w FROM cw{tag}, range(0, {-(-n // 32)}) b(b)) t, range(0, 32) bit(i) GROUP BY ALL),
      pv{tag} AS (SELECT count(*) FILTER (abs(stat) >= abs(macro) - 1e-15) AS n_extreme, count(*) AS n_permutations,
        (count(*) FILTER (abs(stat) >= abs(macro) - 1e-15) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE) AS p_value FROM sg{tag}, ob{tag} WHERE p < {n})"""


_DIFF = """SELECT avg(m) AS macro_diff, sum(t) / sum(n) AS micro_diff, sum(w) AS query_wins, sum(l) AS query_losses, sum(e) AS query_ties, sum(n) AS n_queries, count(*) AS n_datasets FROM (
    SELECT dataset, avg(diff) AS m, sum(diff) AS t, count(*) AS n, count(*) FILTER (diff > 0) AS w, count(*) FILTER (diff < 0) AS l, count(*) FILTER (diff = 0) AS e FROM pd GROUP BY dataset)"""


@query("paired_diff", "macro_diff 8, micro_diff 8, query_wins i, query_losses i, query_ties i, n_queries i, n_datasets i", _DIFF)
def paired_diff(spark, sf):
    return paired.difference(_frame(spark, sf))


def _bootstrap(grouped):
    def run(spark, sf):
        u = paired.units(_frame(spark, sf, grouped), grouped)
        q = paired.bootstrap_quantiles(paired.bootstrap_replicates(u, BOOT, SEED), [0.025, 0.975])
        return q.select(F.col("q0").alias("lo"), F.col("q1").alias("hi"))

    run.__doc__ = "Bootstrap interval of the macro difference" + (" over clusters of repeated inputs." if grouped else ".")
    return run


def _permutation(grouped):
    def run(spark, sf):
        frame = _frame(spark, sf, grouped)
        stats = paired.permutation_stats(paired.contributions(frame, grouped), PERM, SEED)
        return paired.permutation_p(stats, paired.difference(frame))

    run.__doc__ = "Sign-flip p-value" + (" with repeated inputs flipped together." if grouped else ".")
    return run


for _g, _suffix in ((False, ""), (True, "_clustered")):
    query(f"paired_bootstrap_ci{_suffix}", "lo 8, hi 8", f"WITH {_boot(_g)} SELECT lo, hi FROM ci")(_bootstrap(_g))
    query(f"paired_permutation_p{_suffix}", "n_extreme i, n_permutations i, p_value 10", f"WITH {_perm(_g)} SELECT * FROM pv")(_permutation(_g))


@query(
    "paired_bootstrap_counts",
    "n_replicates i, macro_diff 8, se 8, centred b, spread_ok b",
    f"""WITH df AS ({_DIFF}), th AS (SELECT sqrt(sum(v)) / count(*) AS se FROM (SELECT var_pop(diff) / count(*) AS v FROM pd GROUP BY dataset))
        SELECT {BOOT} AS n_replicates, macro_diff, se, true AS centred, true AS spread_ok FROM df, th""",
)
def paired_bootstrap_counts(spark, sf):
    """The multinomial way: its replicates centre on the difference with the deviation the sample implies."""
    frame = _frame(spark, sf)
    reps = paired.bootstrap_replicates(paired.units(frame), BOOT, SEED, draw="counts")
    per = frame.groupBy("dataset").agg((F.var_pop("diff") / F.count("*")).alias("v"))
    theory = per.agg((F.sqrt(F.sum("v")) / F.count("*")).alias("se"))
    seen = reps.agg(F.count("*").alias("n_replicates"), F.avg("macro").alias("m"), F.stddev_samp("macro").alias("s"))
    one = seen.join(F.broadcast(theory)).join(F.broadcast(paired.difference(frame).select("macro_diff")))
    return one.withColumn("centred", F.abs(F.col("m") - F.col("macro_diff")) < F.col("se") / 8).withColumn(
        "spread_ok", F.abs(F.col("s") / F.col("se") - 1) < 0.1
    )


_TEST_SPEC = (
    "macro_diff_pp 6, micro_diff_pp 6, bootstrap_ci_low_pp 6, bootstrap_ci_high_pp 6, permutation_p_two_sided 10, n_queries i, n_datasets i, "
    "n_inference_clusters i, cluster_duplicate_inputs b, query_wins i, query_losses i, query_ties i"
)


@query(
    "paired_prediction_test",
    _TEST_SPEC,
    f"""WITH {_boot(True)}, {_perm(True)}, df AS ({_DIFF}) SELECT macro_diff * 100 AS macro_diff_pp, micro_diff * 100 AS micro_diff_pp, lo * 100 AS bootstrap_ci_low_pp, hi * 100 AS bootstrap_ci_high_pp,
        p_value AS permutation_p_two_sided, n_queries, n_datasets, (SELECT count(*) FROM un) AS n_inference_clusters, true AS cluster_duplicate_inputs, query_wins, query_losses, query_ties FROM df, ci, pv""",
)
def paired_prediction_test(spark, sf):
    return paired.prediction_test(*_sides(spark, sf), n_bootstrap=BOOT, n_permutations=PERM, seed=SEED, grouped=True)


@query(
    "paired_equivalence",
    "macro_diff_pp 6, bootstrap_ci_low_pp 6, bootstrap_ci_high_pp 6, margin_pp 4, noninferior_A_to_B b, equivalent_within_margin b, n_queries i, n_datasets i",
    f"""WITH {_boot(False)}, df AS ({_DIFF}) SELECT macro_diff * 100 AS macro_diff_pp, lo * 100 AS bootstrap_ci_low_pp, hi * 100 AS bootstrap_ci_high_pp, 2.5 AS margin_pp,
        lo * 100 > -2.5 AS noninferior_A_to_B, lo * 100 > -2.5 AND hi * 100 < 2.5 AS equivalent_within_margin, n_queries, n_datasets FROM df, ci""",
)
def paired_equivalence(spark, sf):
    return paired.equivalence(paired.prediction_test(*_sides(spark, sf), n_bootstrap=BOOT, n_permutations=PERM, seed=SEED), 2.5)


@query(
    "paired_noninferiority",
    "macro_diff_pp 6, margin_pp 4, confidence 4, lower_one_sided_pp 6, bootstrap_ci_low_pp 6, bootstrap_ci_high_pp 6, noninferior_A_to_B b, n_queries i, n_datasets i, n_inference_clusters i",
    f"""WITH {_boot(True, n=BOUND)}, df AS ({_DIFF}) SELECT macro_diff * 100 AS macro_diff_pp, 1.5 AS margin_pp, 0.95 AS confidence, one * 100 AS lower_one_sided_pp, lo * 100 AS bootstrap_ci_low_pp, hi * 100 AS bootstrap_ci_high_pp,
        one * 100 > -1.5 AS noninferior_A_to_B, n_queries, n_datasets, (SELECT count(*) FROM un) AS n_inference_clusters FROM df, ci""",
)
def paired_noninferiority(spark, sf):
    return paired.noninferiority(*_sides(spark, sf), margin_pp=1.5, n_bootstrap=BOUND, seed=SEED, grouped=True)


SUITE_SEEDS = (1, 2, 3, 4, 5)


@query(
    "paired_seed_suite",
    "n_seeds i, macro_diff_pp_mean 6, macro_diff_pp_std 6, micro_diff_pp_mean 6, micro_diff_pp_std 6, positive_seeds i, negative_seeds i",
    f"""WITH sd AS (SELECT seed, system FROM (VALUES {', '.join(f'({s})' for s in SUITE_SEEDS)}) a(seed), (VALUES ('alpha'), ('beta')) b(system)),
       q AS (SELECT seed, system, sample_id, dataset, score, {unit('seed', 'system', 'sample_id', 'model')} AS q, model FROM po, sd),
       k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, system, sample_id ORDER BY q DESC, model) AS rn FROM q) WHERE rn = 1),
       d AS (SELECT a.seed, a.dataset, avg(a.score - b.score) AS m, sum(a.score - b.score) AS t, count(*) AS n
         FROM k a JOIN k b ON a.seed = b.seed AND a.sample_id = b.sample_id WHERE a.system = 'alpha' AND b.system = 'beta' GROUP BY ALL),
       s AS (SELECT seed, avg(m) * 100 AS macro, sum(t) / sum(n) * 100 AS micro FROM d GROUP BY seed)
       SELECT count(*) AS n_seeds, avg(macro) AS macro_diff_pp_mean, coalesce(stddev_samp(macro), 0) AS macro_diff_pp_std, avg(micro) AS micro_diff_pp_mean,
         coalesce(stddev_samp(micro), 0) AS micro_diff_pp_std, count(*) FILTER (macro > 0) AS positive_seeds, count(*) FILTER (macro < 0) AS negative_seeds FROM s""",
)
def paired_seed_suite(spark, sf):
    """A whole test per seed, all draws included; the suite reports what is not pooled."""
    rows = None
    for s in SUITE_SEEDS:
        test = summary(paired.prediction_test(*_sides(spark, sf, s), n_bootstrap=BOOT, n_permutations=PERM, seed=SEED + s))
        rows = test if rows is None else rows.unionByName(test)
    return paired.seed_suite(rows)


# ---- checks ------------------------------------------------------------------------------------------

_CHECK_SPEC = "check s, passed b, observed s"


def _expected(spark, sf):
    """What the pool should hold: the right sizes but for one wrong count of datasets."""
    n = pools.p_samples(spark, sf).count()
    return checks.Expected(samples=n, datasets=24, models=len(MODELS), outcomes=n * len(MODELS), reference_model="m3")


_ID = "CAST(sample_id AS BIGINT)"
_FAULTS = f"""fs AS (SELECT sample_id, dataset FROM ps UNION ALL SELECT sample_id, dataset FROM ps WHERE key % 500 = 1),
    fo AS (SELECT sample_id, model FROM po WHERE {_ID} % 400 <> 3 UNION ALL SELECT sample_id, model FROM po WHERE {_ID} % 300 = 2 AND model = 'm2'
      UNION ALL SELECT 'x' || sample_id, model FROM po WHERE {_ID} % 700 = 5 AND model = 'm1')"""
_POOL = [
    ("samples", "(SELECT count(*) FROM fs)", "(SELECT count(*) FROM ps)"),
    ("datasets", "(SELECT count(DISTINCT dataset) FROM fs)", "24"),
    ("outcomes", "(SELECT count(*) FROM fo)", "7 * (SELECT count(*) FROM ps)"),
    ("models", "(SELECT count(DISTINCT model) FROM fo)", "7"),
    ("duplicate samples", "(SELECT count(*) FROM (SELECT sample_id FROM fs GROUP BY ALL HAVING count(*) > 1))", "0"),
    ("duplicate outcomes", "(SELECT count(*) FROM (SELECT sample_id, model FROM fo GROUP BY ALL HAVING count(*) > 1))", "0"),
    ("samples without outcome", "(SELECT count(*) FROM fs WHERE sample_id NOT IN (SELECT sample_id FROM fo))", "0"),
    ("outcomes without sample", "(SELECT count(*) FROM fo WHERE sample_id NOT IN (SELECT sample_id FROM fs))", "0"),
    ("reference candidate", "(SELECT count(*) FROM (SELECT 1 FROM fo WHERE model = 'm3' LIMIT 1))", "1"),
]


def _pool_sql(label: str) -> str:
    return " UNION ALL ".join(f"SELECT '{label}: {n}' AS \"check\", {v} = {e} AS passed, CAST({v} AS VARCHAR) AS observed" for n, v, e in _POOL)


def _faulty(spark, sf):
    """The pool with faults: samples twice, outcomes missing, twice and of unknown samples."""
    samples, outcomes = pools.p_samples(spark, sf), pools.p_outcomes(spark, sf)
    key = F.col("sample_id").cast("long")
    twice = outcomes.where((key % 300 == 2) & (F.col("model") == "m2"))
    stray = outcomes.where((key % 700 == 5) & (F.col("model") == "m1")).withColumn("sample_id", F.concat(F.lit("x"), "sample_id"))
    return samples.unionByName(samples.where("key % 500 = 1")).persist(), outcomes.where(key % 400 != 3).unionByName(twice).unionByName(stray).persist()


@query("pool_validation", _CHECK_SPEC, f"WITH {_FAULTS} {_pool_sql('pool')}")
def pool_validation(spark, sf):
    return checks.pool_checks("pool", *_faulty(spark, sf), _expected(spark, sf))


_FEATURE = [
    ("rows", "(SELECT count(*) FROM ps)"), ("ids", "(SELECT count(*) FROM ps)"), ("features", "40"), ("not finite", "0"), ("out of range", "0"),
    ("samples without features", "0"), ("features without sample", "0"),
]
_RELEASE = f"WITH {_FAULTS} " + _pool_sql("performance") + "".join(
    f" UNION ALL SELECT 'sem: {n}', true, CAST({v} AS VARCHAR)" for n, v in _FEATURE
) + """ UNION ALL SELECT 'direct: duplicate predictions', true, '0' UNION ALL SELECT 'direct: samples without prediction', true, '0'
  UNION ALL SELECT 'direct: predictions without sample', true, '0' UNION ALL SELECT 'vectors: dimensions', true, '1'
  UNION ALL SELECT 'vectors: samples without vector', count(*) = 0, CAST(count(*) AS VARCHAR) FROM ps WHERE sample_id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)"""


@query("release_validation", _CHECK_SPEC, _RELEASE)
def release_validation(spark, sf):
    samples = pools.p_samples(spark, sf).persist()
    expected = _expected(spark, sf)
    frame, a, _ = _sides(spark, sf)
    tables = [
        checks.pool_checks("performance", *_faulty(spark, sf), expected),
        checks.feature_checks("sem", pools.p_features(samples), BACKEND, samples, expected),
        checks.prediction_checks("direct", a.select("sample_id", "selected_score").persist(), samples),
        checks.vector_checks("vectors", pools.d_vectors(spark, sf), samples),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


# ---- enrichment --------------------------------------------------------------------------------------


def _judge(query: str) -> str:
    """A stand-in judgment: the number of words; a text of one word cannot be judged."""
    words = query.split()
    if len(words) < 2:
        raise ValueError("too short")
    return json.dumps({"words": len(words)})


@query(
    "enrich_resumable",
    "requested i, completed i, failed i",
    """SELECT count(*) AS requested, count(*) FILTER (key % 10 <> 0) AS completed, count(*) FILTER (key % 10 = 0) AS failed FROM p_samples WHERE sample_id NOT IN (SELECT sample_id FROM p_ids)""",
)
def enrich_resumable(spark, sf):
    """Complete parts count as done; every tenth other text is too short and fails."""
    samples = pools.p_all_samples(spark, sf)
    query = F.when(F.col("key") % 10 == 0, F.lit("word")).otherwise(F.col("query"))
    rows = samples.select("sample_id", query.alias("query"))
    return enrich.enrich(rows, pools.p_samples(spark, sf), _judge, scratch_path(spark, "enriched"))


@query(
    "enrich_dedup_cache",
    "sample_id s, words i, cached b",
    "SELECT sample_id, len(string_split(query, ' ')) AS words, query LIKE 'a%' OR query LIKE 's%' AS cached FROM p_samples",
)
def enrich_dedup_cache(spark, sf):
    """Part names repeat a lot; some are already in the cache."""
    samples = pools.p_all_samples(spark, sf).select("sample_id", "query")
    known = samples.where("query like 'a%' or query like 's%'").select("query").distinct()
    cache = known.select(
        enrich.request_key(F.col("query"), "manual-v1", "judge").alias("request_key"),
        F.to_json(F.struct(F.size(F.split("query", " ")).alias("words"))).alias("answers"),
    )
    rows, _ = enrich.answered_once(samples, cache, _judge, "manual-v1", "judge")
    return rows.select("sample_id", F.get_json_object("answers", "$.words").alias("words"), "cached")


del collapse
