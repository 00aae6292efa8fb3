"""Queries: semantic features, representations, TF-IDF, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointsman.catalog import pools
from pointsman.catalog.pools import BACKEND
from pointsman.catalog.registry import query
from pointsman.catalog.sql import collapse, h_text
from pointsman.functions import numeric, text
from pointsman.operators import features, splits, tfidf
from pointsman.operators.features import FAMILY_LABELS, FAMILY_PROBE, FeatureSet

# ---- encoding ---------------------------------------------------------------------------------


@query("encode_answer", "sample_id s, probe s, stat s, level s, value 8", "SELECT sample_id, probe, stat, level, value FROM pf_long")
def encode_answer(spark, sf):
    return features.encode_long(pools.p_decisions(pools.p_samples(spark, sf)))


@query("encode_vectors", "sample_id s, feature s, value 8", "SELECT sample_id, feature, value FROM pf")
def encode_vectors(spark, sf):
    """The same statistics without exploding, as arrays in a fixed feature order."""
    return features.encode_vectors(pools.p_decisions(pools.p_samples(spark, sf)), BACKEND).long()


@query(
    "encode_meta",
    "sample_id s, meta_sem_input_tokens 4, meta_sem_latency_ms 4",
    "SELECT sample_id, 100 + key % 500 AS meta_sem_input_tokens, CAST(key * 7 % 1000 AS DOUBLE) / 4 AS meta_sem_latency_ms FROM ps",
)
def encode_meta(spark, sf):
    return features.encode_meta(pools.p_decisions(pools.p_samples(spark, sf)), BACKEND)


@query(
    "profile_usage",
    "n_samples i, input_tokens_mean 6, input_tokens_p50 6, input_tokens_p95 6, input_tokens_total 2, estimated_input_cost_total 10, estimated_input_cost_per_query 12, latency_ms_mean 6, latency_ms_p50 6, latency_ms_p95 6",
    """WITH m AS (SELECT CAST(100 + key % 500 AS DOUBLE) AS t, CAST(key * 7 % 1000 AS DOUBLE) / 4 AS l FROM ps)
       SELECT count(*) AS n_samples, avg(t) AS input_tokens_mean, quantile_cont(t, 0.5) AS input_tokens_p50, quantile_cont(t, 0.95) AS input_tokens_p95, sum(t) AS input_tokens_total,
         sum(t) / 1e6 * 0.042 AS estimated_input_cost_total, avg(t) / 1e6 * 0.042 AS estimated_input_cost_per_query,
         avg(l) AS latency_ms_mean, quantile_cont(l, 0.5) AS latency_ms_p50, quantile_cont(l, 0.95) AS latency_ms_p95 FROM m""",
)
def profile_usage(spark, sf):
    meta = features.encode_meta(pools.p_decisions(pools.p_samples(spark, sf)), BACKEND)
    return features.profile_usage(meta, BACKEND, 0.042)


_MASS = """SELECT sample_id, probe, k, p FROM pf_score"""


@query(
    "parse_probabilities",
    "sample_id s, probe s, pos i, key s, p 8",
    f"""SELECT sample_id, probe, k AS pos, CAST(k AS VARCHAR) AS key, p FROM ({_MASS})
        UNION ALL SELECT sample_id, '{FAMILY_PROBE}', list_position({list(FAMILY_LABELS)!r}, label) - 1, label, p FROM pf_fam""",
)
def parse_probabilities(spark, sf):
    rows = pools.p_decisions(pools.p_samples(spark, sf)).select("sample_id", F.explode("answers").alias("probe", "a"))
    scored = rows.where("a.probabilities is not null").select("sample_id", "probe", F.posexplode(features.parse_probabilities(F.col("a.probabilities"))).alias("pos", "e"))
    return scored.select("sample_id", "probe", "pos", F.col("e.key").alias("key"), F.col("e.value").alias("p"))


def _weights_table(spark, sf):
    """Order lines of a part as a mass that need not sum to 1 and holds zeros."""
    li = pools.table(spark, sf, "lineitem")
    cells = li.groupBy("l_partkey", "l_linenumber").agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) % 9).alias("w"))
    return cells.groupBy(pools.text_id("l_partkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "w"))).alias("a")).select(
        "sample_id",
        F.transform("a", lambda s: s["w"].cast("double") / 16).alias("p"),
        F.transform("a", lambda s: s["l_linenumber"].cast("double")).alias("levels"),
    )


_W = """w AS (SELECT CAST(l_partkey AS VARCHAR) AS sample_id, l_linenumber AS k, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) % 9 AS DOUBLE) / 16 AS p FROM lineitem GROUP BY l_partkey, l_linenumber)"""


@query(
    "entropy_norm",
    "sample_id s, entropy 8",
    f"WITH {_W} SELECT sample_id, coalesce(sum(CASE WHEN p > 0 THEN -p * ln(p) END), 0) / CASE WHEN count(*) > 1 THEN ln(count(*)) ELSE 1 END AS entropy FROM w GROUP BY sample_id",
)
def entropy_norm(spark, sf):
    return _weights_table(spark, sf).select("sample_id", numeric.entropy_norm(F.col("p")).alias("entropy"))


@query(
    "expected_level_spread",
    "sample_id s, expected 8, spread 7",
    f"WITH {_W} SELECT sample_id, sum(k * p) AS expected, sqrt(greatest(0, sum(k * k * p) - sum(k * p) * sum(k * p))) AS spread FROM w GROUP BY sample_id",
)
def expected_level_spread(spark, sf):
    levels, p = F.col("levels"), F.col("p")
    return _weights_table(spark, sf).select("sample_id", numeric.moment(levels, p, 1).alias("expected"), numeric.spread(levels, p).alias("spread"))


@query("expected_level", "sample_id s, expected 8", f"WITH {_W} SELECT sample_id, sum(k * p) AS expected FROM w GROUP BY sample_id")
def expected_level(spark, sf):
    return _weights_table(spark, sf).select("sample_id", numeric.moment(F.col("levels"), F.col("p"), 1).alias("expected"))


@query(
    "spread",
    "sample_id s, spread 7",
    f"WITH {_W} SELECT sample_id, sqrt(greatest(0, sum(k * k * p) - sum(k * p) * sum(k * p))) AS spread FROM w GROUP BY sample_id",
)
def spread(spark, sf):
    return _weights_table(spark, sf).select("sample_id", numeric.spread(F.col("levels"), F.col("p")).alias("spread"))


@query(
    "binary_entropy",
    "sample_id s, entropy 8",
    """SELECT sample_id, ((CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) + (CASE WHEN p < 1 THEN -(1 - p) * ln(1 - p) ELSE 0 END)) / ln(2) AS entropy
       FROM (SELECT sample_id, CAST(key % 9 AS DOUBLE) / 8 AS p FROM p_samples)""",
)
def binary_entropy(spark, sf):
    return pools.p_all_samples(spark, sf).select("sample_id", numeric.binary_entropy((F.col("key") % 9).cast("double") / 8).alias("entropy"))


@query("sanitize_label", "label s, clean s", "SELECT DISTINCT p_name || '/' || p_type AS label, replace(replace(p_name || '/' || p_type, ' ', '_'), '/', '_') AS clean FROM part")
def sanitize_label(spark, sf):
    label = F.concat("p_name", F.lit("/"), "p_type").alias("label")
    return pools.table(spark, sf, "part").select(label).distinct().select("label", text.sanitize_label(F.col("label")).alias("clean"))


@query("probe_of_column", "sample_id s, feature s, probe s", "SELECT sample_id, feature, probe FROM pf")
def probe_of_column(spark, sf):
    rows = pools.p_features(pools.p_samples(spark, sf)).long()
    return rows.select("sample_id", "feature", text.probe_of(F.col("feature")).alias("probe"))


@query(
    "probe_view",
    "sample_id s, probe s, kind s, probability_yes 8, n_levels i, top 8",
    """SELECT sample_id, probe, 'binary' AS kind, p AS probability_yes, 0 AS n_levels, CAST(NULL AS DOUBLE) AS top FROM pf_noul
       UNION ALL SELECT sample_id, probe, 'score', NULL, 4, max(p) FILTER (k = 3) FROM pf_score GROUP BY sample_id, probe""",
)
def probe_view(spark, sf):
    view = features.probe_view(pools.p_features(pools.p_samples(spark, sf)), BACKEND)
    return view.select(
        "sample_id", "probe", "kind", "probability_yes", F.size("probabilities").alias("n_levels"), F.element_at("probabilities", F.lit(3)).alias("top")
    )


# ---- representations ------------------------------------------------------------------------------

_FINE = f"probe <> '{FAMILY_PROBE}'"
_REP = {
    "full": _FINE,
    "probability_mass": f"{_FINE} AND stat IN ('noul', 'p')",
    "no_entropy": f"{_FINE} AND stat <> 'entropy'",
    "primary": f"{_FINE} AND stat IN ('noul', 'expected')",
    "primary_entropy": f"{_FINE} AND stat IN ('noul', 'expected', 'entropy')",
}


def _representation(mode):
    def run(spark, sf):
        return features.representation(pools.p_features(pools.p_samples(spark, sf)), mode, BACKEND).long()

    run.__doc__ = f"Features of the {mode} representation."
    return run


for _mode, _where in _REP.items():
    query(f"rep_{_mode}", "sample_id s, feature s, value 8", f"SELECT sample_id, feature, value FROM pf WHERE {_where}")(_representation(_mode))


@query(
    "rep_hard",
    "sample_id s, feature s, value 6",
    """SELECT sample_id, 'sem_' || probe || '__hard' AS feature, CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END AS value FROM pf_noul
       UNION ALL SELECT sample_id, 'sem_' || probe || '__hard', CAST(k AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, probe ORDER BY p DESC, CAST(k AS VARCHAR)) AS rn FROM pf_score) WHERE rn = 1""",
)
def rep_hard(spark, sf):
    return _representation("hard")(spark, sf)


_SOME = {"math_reasoning", "ambiguity", "exactness"}
_SOME_SQL = ", ".join(f"'{p}'" for p in sorted(_SOME))


@query("rep_drop_probe", "sample_id s, feature s, value 8", f"SELECT sample_id, feature, value FROM pf WHERE {_REP['probability_mass']} AND probe NOT IN ({_SOME_SQL})")
def rep_drop_probe(spark, sf):
    return features.drop_probes(pools.p_mass(pools.p_samples(spark, sf)), _SOME, BACKEND).long()


@query("rep_keep_probes", "sample_id s, feature s, value 8", f"SELECT sample_id, feature, value FROM pf WHERE {_REP['probability_mass']} AND probe IN ({_SOME_SQL})")
def rep_keep_probes(spark, sf):
    return features.keep_probes(pools.p_mass(pools.p_samples(spark, sf)), _SOME, BACKEND).long()


@query(
    "select_feature_columns",
    "feature_set s, sample_id s, n i, total 6",
    f"""SELECT f.feature_set, sample_id, count(*) AS n, sum(value) AS total FROM pf, (VALUES ('semantic'), ('semantic_manual'), ('semantic_all'), ('domain_only'), ('semantic_plus_deterministic')) f(feature_set)
        WHERE f.feature_set IN ('semantic_all', 'semantic_plus_deterministic') OR (f.feature_set = 'domain_only') = (probe = '{FAMILY_PROBE}') GROUP BY ALL
        UNION ALL SELECT 'all', sample_id, count(*) + 1, sum(value) + any_value(size) FROM pf JOIN ps USING (sample_id) GROUP BY sample_id
        UNION ALL SELECT 'deterministic', sample_id, 1, size FROM ps""".replace("UNION ALL SELECT 'all'", "UNION ALL SELECT 'all'").replace("('semantic_plus_deterministic')) f", "('semantic_plus')) f").replace("'semantic_all', 'semantic_plus_deterministic') OR", "'semantic_all', 'semantic_plus') OR")
    + " UNION ALL SELECT 'semantic_plus_deterministic', sample_id, count(*) + 1, sum(value) + any_value(size) FROM pf JOIN ps USING (sample_id) GROUP BY sample_id",
)
def select_feature_columns(spark, sf):
    """Every named feature set of a table that also has a det_ and a meta_ column."""
    samples = pools.p_samples(spark, sf)
    fs = pools.p_features(samples)
    extra = samples.select("sample_id", F.array(F.col("size").cast("double"), F.lit(7.0)).alias("e"))
    wide = FeatureSet(
        fs.df.join(extra, "sample_id").select("sample_id", F.concat("x", "e").alias("x")), [*fs.names, "det_size", "meta_sem_latency_ms"]
    )
    out = None
    for name in features.FEATURE_SETS:
        rows = wide.take(features.feature_set_names(wide.names, name, BACKEND)).df
        held = F.filter("x", lambda v: v.isNotNull())
        one = rows.select(F.lit(name).alias("feature_set"), "sample_id", F.size(held).alias("n"), numeric.total(held).alias("total"))
        out = one if out is None else out.unionByName(one)
    extra_set = out.where("feature_set = 'semantic_all'").withColumn("feature_set", F.lit("semantic_plus"))
    return out.unionByName(extra_set)


@query("align_features", "sample_id s, pos i, value 8", "SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY feature) - 1 AS pos, value FROM pm")
def align_features(spark, sf):
    fs = pools.p_features(pools.p_samples(spark, sf))
    order = sorted(features.representation_names(fs.names, "probability_mass", BACKEND))
    return features.align(fs, order).df.select("sample_id", F.posexplode("x").alias("pos", "value"))


@query(
    "feature_quality_check",
    "n_rows i, n_ids i, n_features i, n_not_finite i, n_out_of_range i",
    "SELECT count(DISTINCT sample_id) AS n_rows, count(DISTINCT sample_id) AS n_ids, count(DISTINCT feature) AS n_features, 0 AS n_not_finite, count(*) FILTER (value < 0 OR value > 1) AS n_out_of_range FROM pm",
)
def feature_quality_check(spark, sf):
    return features.quality_check(pools.p_features(pools.p_samples(spark, sf)), BACKEND)


@query("semantic_entropy", "sample_id s, uncertainty 8", "SELECT sample_id, uncertainty FROM pf_entropy")
def semantic_entropy(spark, sf):
    return pools.entropy_table(pools.p_samples(spark, sf))


_WORDS = """tok AS (SELECT sample_id, list_filter(regexp_extract_all(lower(query), '[\\p{L}\\p{N}\\p{M}_\\p{Pc}]+'), lambda w: length(w) >= 2) AS w FROM d_samples),
    grams AS (SELECT sample_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok),
    tf AS (SELECT sample_id, term, count(*) AS tf FROM grams GROUP BY ALL),
    voc AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 50000),
    wt AS (SELECT sample_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM d_samples)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term))"""


@query(
    "tfidf_features",
    "sample_id s, term s, weight 8",
    f"WITH {_WORDS} SELECT sample_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) AS weight FROM wt",
)
def tfidf_features(spark, sf):
    return tfidf.tfidf_features(pools.d_samples(spark, sf))


# ---- splits ------------------------------------------------------------------------------------------


def _share(n: str, r: float) -> str:
    return f"CASE WHEN {n} > 1 THEN greatest(1, least({n} - 1, CAST(round_even({n} * {r}::DOUBLE, 0) AS BIGINT))) ELSE 1 END"


def _split_sql(seed: int, ratio: float, source: str = "ps", unit: str = "sample_id", a: str = "train", b: str = "test") -> str:
    """Split of a source with sample_id and dataset by the hash order of a unit column."""
    return f"""SELECT r.sample_id, CASE WHEN u.rn <= {_share('u.n', ratio)} THEN '{a}' ELSE '{b}' END AS partition FROM {source} r JOIN (
        SELECT dataset, unit, row_number() OVER (PARTITION BY dataset ORDER BY {h_text(str(seed), 'unit')}) AS rn, count(*) OVER (PARTITION BY dataset) AS n
        FROM (SELECT DISTINCT dataset, {unit} AS unit FROM {source})) u ON u.dataset = r.dataset AND u.unit = r.{unit}"""


def _fold_sql(seed: int, k: int, source: str = "ps", unit: str = "sample_id") -> str:
    return f"""SELECT r.sample_id, u.fold FROM {source} r JOIN (
        SELECT dataset, unit, ntile({k}) OVER (PARTITION BY dataset ORDER BY {h_text(str(seed), 'unit')}) - 1 AS fold
        FROM (SELECT DISTINCT dataset, {unit} AS unit FROM {source})) u ON u.dataset = r.dataset AND u.unit = r.{unit}"""


@query("id_split", "sample_id s, partition s", _split_sql(42, 0.7))
def id_split(spark, sf):
    return splits.id_split(pools.p_samples(spark, sf), 0.7, 42)


@query("id_split_grouped", "sample_id s, partition s", _split_sql(3407, 0.7, "groups", "leakage_group"))
def id_split_grouped(spark, sf):
    return splits.id_split(pools.p_samples(spark, sf), 0.7, 3407, grouped=True)


_D_GROUPS = f"dg AS (SELECT *, sha256(dataset || chr(0) || {collapse('query')}) AS leakage_group FROM d_samples)"


@query("id_split_texts", "sample_id s, partition s", f"WITH {_D_GROUPS} {_split_sql(7, 0.7, 'dg', 'leakage_group')}")
def id_split_texts(spark, sf):
    """Documents with copies: all copies of a text fall on one side."""
    return splits.id_split(pools.d_samples(spark, sf), 0.7, 7, grouped=True)


@query("dataset_ood_split", "sample_id s, partition s", "SELECT sample_id, CASE WHEN dataset = 'Brand#7' THEN 'test' ELSE 'train' END AS partition FROM ps")
def dataset_ood_split(spark, sf):
    return splits.holdout_split(pools.p_samples(spark, sf), "dataset", "BRAND#7")


@query("domain_ood_split", "sample_id s, partition s", "SELECT sample_id, CASE WHEN domain = 'ECONOMY' THEN 'test' ELSE 'train' END AS partition FROM ps")
def domain_ood_split(spark, sf):
    return splits.holdout_split(pools.p_samples(spark, sf), "domain", "economy")


@query("stratified_folds", "sample_id s, fold i", _fold_sql(3407, 5))
def stratified_folds(spark, sf):
    return splits.stratified_folds(pools.p_samples(spark, sf), 5, 3407)


@query("stratified_folds_grouped", "sample_id s, fold i", _fold_sql(3407, 5, "groups", "leakage_group"))
def stratified_folds_grouped(spark, sf):
    return splits.stratified_folds(pools.p_samples(spark, sf), 5, 3407, grouped=True)


_OUTER = f"ou AS ({_split_sql(3407, 0.7, 'groups', 'leakage_group')}), tr AS (SELECT * FROM groups WHERE sample_id IN (SELECT sample_id FROM ou WHERE partition = 'train'))"


@query(
    "nested_split",
    "sample_id s, partition s",
    f"WITH {_OUTER} {_split_sql(3407 + splits.INNER_SEED_STEP, 0.8, 'tr', 'leakage_group', 'inner_fit', 'validation')} UNION ALL SELECT sample_id, partition FROM ou WHERE partition = 'test'",
)
def nested_split(spark, sf):
    return splits.nested_split(pools.p_samples(spark, sf))


@query(
    "calibration_split",
    "sample_id s, partition s",
    f"WITH pool AS (SELECT * FROM ps WHERE domain <> 'PROMO') {_split_sql(3407, 0.8, 'pool', 'sample_id', 'fit', 'calibration')} UNION ALL SELECT sample_id, 'test' FROM ps WHERE domain = 'PROMO'",
)
def calibration_split(spark, sf):
    return splits.calibration_split(pools.p_samples(spark, sf), "promo")
