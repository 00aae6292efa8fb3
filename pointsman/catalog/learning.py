"""Queries: learners, prediction, experiments and cost protocols."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pointsman.catalog import pools
from pointsman.catalog.pools import BACKEND
from pointsman.catalog.quality import METRIC_SPEC
from pointsman.catalog.registry import query
from pointsman.catalog.semantic import _D_GROUPS, _fold_sql, _share, _split_sql
from pointsman.catalog.sql import MODELS, h, h_text
from pointsman.functions import draws
from pointsman.operators.features import BINARY_PROBES, SCORE_PROBES
from pointsman.operators import boosting, cost, features, linear, metrics, paired, routing, selective, splits
from pointsman.plans import experiments
from pointsman.session import join_checked, scratch_path, summary
from pointsman.sources import tables
from pointsman.streaming import monitor
from pointsman.streaming import route as live

_LONG_PRED = F.posexplode


def ridge_sql(
    p: str, train: str, target: str, apply: str, alpha: str = "1", source: str = "SELECT sample_id, feature, value FROM pm", d: int = 40, scale: bool = True,
    mask: str = "true",
) -> str:
    """Expressions that fit ridge by Gauss-Jordan elimination, one fit per group g.

    train: (g, sample_id); target: (g, t, sample_id, y) with numeric t; apply: (g, sample_id).
    A feature outside `mask` is 0 in that group, which gives it a coefficient of 0.
    Gives {p}_coef (g, t, i, w, mean, dev), {p}_bias (g, t, mean) and {p}_pred (g, sample_id, t, pred).
    """
    dev = "CASE WHEN var_pop(v) <= 1e-12 THEN 1 ELSE stddev_pop(v) END" if scale else "1"
    return f"""{p}_fx AS (SELECT sample_id, feature, dense_rank() OVER (ORDER BY feature) AS i, value AS v FROM ({source})),
      {p}_trn AS ({train}), {p}_tg AS ({target}), {p}_app AS ({apply}),
      {p}_st AS (SELECT g, i, any_value(feature) AS feature, avg(v) AS mean, CAST({dev} AS DOUBLE) AS dev FROM {p}_trn JOIN {p}_fx USING (sample_id) GROUP BY g, i),
      {p}_z AS (SELECT g, sample_id, i, CASE WHEN {mask.replace('feature', p + '_fx.feature')} THEN (v - mean) / dev ELSE 0 END AS z FROM {p}_trn JOIN {p}_fx USING (sample_id) JOIN {p}_st USING (g, i)),
      {p}_bias AS (SELECT g, t, avg(y) AS mean FROM {p}_trn JOIN {p}_tg USING (g, sample_id) GROUP BY g, t),
      {p}_a AS (SELECT a.g, a.i, b.i AS j, sum(a.z * b.z) + CASE WHEN a.i = b.i THEN CAST({alpha.replace('g', 'any_value(a.g)') if 'g' in alpha else alpha} AS DOUBLE) ELSE 0 END AS v
        FROM {p}_z a JOIN {p}_z b ON a.g = b.g AND a.sample_id = b.sample_id GROUP BY a.g, a.i, b.i),
      {p}_b AS (SELECT z.g, z.i, {d} + dense_rank() OVER (PARTITION BY z.g ORDER BY y.t) AS j, sum(z.z * (y.y - m.mean)) AS v
        FROM {p}_z z JOIN {p}_tg y ON y.g = z.g AND y.sample_id = z.sample_id JOIN {p}_bias m ON m.g = y.g AND m.t = y.t GROUP BY z.g, z.i, y.t),
      {p}_rows AS (SELECT g, i, list(v ORDER BY j) AS r FROM (SELECT * FROM {p}_a UNION ALL SELECT * FROM {p}_b) GROUP BY g, i),
      {p}_gj(g, k, m) AS (SELECT g, 1, list(r ORDER BY i) FROM {p}_rows GROUP BY g
        UNION ALL SELECT g, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
          ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM {p}_gj WHERE k <= {d}),
      {p}_ts AS (SELECT g, t, dense_rank() OVER (PARTITION BY g ORDER BY t) AS pos FROM {p}_bias),
      {p}_coef AS (SELECT s.g, s.t, x.i, st.feature, s2.m[x.i][{d} + s.pos] AS w, st.mean, st.dev FROM {p}_ts s JOIN {p}_gj s2 ON s2.g = s.g AND s2.k = {d} + 1,
        range(1, {d} + 1) x(i) JOIN {p}_st st ON st.g = s.g AND st.i = x.i),
      {p}_pred AS (SELECT a.g, a.sample_id, c.t, any_value(m.mean) + sum((f.v - c.mean) / c.dev * c.w) AS pred FROM {p}_app a JOIN {p}_fx f USING (sample_id)
        JOIN {p}_coef c ON c.g = a.g AND c.i = f.i JOIN {p}_bias m ON m.g = a.g AND m.t = c.t GROUP BY a.g, a.sample_id, c.t)"""


_ALL = "SELECT 0 AS g, sample_id FROM ps"
_SCORES = "SELECT 0 AS g, CAST(substr(model, 2) AS BIGINT) AS t, sample_id, score AS y FROM po"


def _mass_frame(spark, sf):
    """The training frame of pool P and its feature names."""
    frame = pools.p_frame(spark, sf)
    fs = pools.p_mass(frame)
    return features.join_features(frame, fs).persist(), fs.names


def _long(rows, models=MODELS, column="pred"):
    return rows.select("sample_id", _LONG_PRED(F.coalesce(column, F.array().cast("array<double>"))).alias("i", "pred")).select(
        "sample_id", routing.name_at(models, F.col("i") + 1).alias("model"), "pred"
    )


# ---- linear learners -----------------------------------------------------------------------------


@query(
    "fit_ridge",
    "model s, feature s, value 6",
    f"""WITH RECURSIVE {ridge_sql('r', _ALL, _SCORES, _ALL)}
        SELECT 'm' || t AS model, feature, w / dev AS value FROM r_coef
        UNION ALL SELECT 'm' || c.t, '(intercept)', any_value(b.mean) - sum(c.w / c.dev * c.mean) FROM r_coef c JOIN r_bias b ON b.g = c.g AND b.t = c.t GROUP BY c.t""",
)
def fit_ridge(spark, sf):
    frame, names = _mass_frame(spark, sf)
    return linear.coefficient_rows(spark, linear.fit(linear.moments(frame, "x", "score")), names, MODELS)


@query(
    "fit_ols",
    "sample_id s, model s, pred 6",
    f"""WITH RECURSIVE {ridge_sql('r', _ALL, _SCORES, _ALL, alpha='0', source="SELECT sample_id, feature, value FROM pm WHERE feature NOT LIKE '%p__3'", d=32)}
        SELECT sample_id, 'm' || t AS model, pred FROM r_pred""",
)
def fit_ols(spark, sf):
    """Least-norm solution on collinear features: predictions equal those without the redundant level."""
    frame, _ = _mass_frame(spark, sf)
    coefs = linear.fit(linear.moments(frame, "x", "score"), alpha=0.0)
    return _long(linear.score(frame, "x", coefs))


_PREDICT = f"WITH RECURSIVE {ridge_sql('r', _ALL, _SCORES, _ALL)} SELECT sample_id, 'm' || t AS model, pred FROM r_pred"


@query("predict_scores", "sample_id s, model s, pred 6", _PREDICT)
def predict_scores(spark, sf):
    frame, _ = _mass_frame(spark, sf)
    return _long(linear.score(frame, "x", linear.fit(linear.moments(frame, "x", "score"))))


@query("save_load_router", "sample_id s, model s, pred 6", _PREDICT)
def save_load_router(spark, sf):
    frame, names = _mass_frame(spark, sf)
    path = scratch_path(spark, "router")
    linear.save_router(spark, path, linear.fit(linear.moments(frame, "x", "score")), names, MODELS)
    coefs, _, models = linear.load_router(spark, path)
    return _long(linear.score(frame, "x", coefs), models)


def _gaps(frame):
    """About a fifth of the cells become unobserved."""
    seen = lambda m: draws.hash_int("gap", F.col("sample_id"), m) % 10 < 8
    names = F.array(*[F.lit(m) for m in MODELS])
    return frame.withColumns({c: F.zip_with(c, names, lambda v, m: F.when(seen(m), v)) for c in ("score", "cost")})


_SPARSE = f"SELECT sample_id, dataset, model, CAST(substr(model, 2) AS BIGINT) AS t, score, cost FROM po WHERE {h(chr(39) + 'gap' + chr(39), 'sample_id', 'model')} % 10 < 8"


@query(
    "fit_per_model_cost",
    "model s, feature s, value 3",
    f"""WITH RECURSIVE sparse AS ({_SPARSE}), {ridge_sql('r', 'SELECT t AS g, sample_id FROM sparse', 'SELECT t AS g, t, sample_id, cost AS y FROM sparse', _ALL, alpha='2')}
        SELECT 'm' || t AS model, feature, w / dev AS value FROM r_coef""",
)
def fit_per_model_cost(spark, sf):
    frame, names = _mass_frame(spark, sf)
    coefs = linear.fit(linear.moments(_gaps(frame), "x", "cost", masked=True), alpha=2.0)
    return linear.coefficient_rows(spark, coefs, names, MODELS).where("feature <> '(intercept)'")


_TWO = ["quality", "toxic"]
_D_TARGET = "SELECT 0 AS g, CASE model WHEN 'quality' THEN 1 ELSE 2 END AS t, sample_id, score AS y FROM d_out"
_D_VEC = """dv AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, 'f' || lpad(CAST(i AS VARCHAR), 3, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS value
    FROM embeddings, range(1, 65) r(i) WHERE CAST(vec_id AS VARCHAR) IN (SELECT sample_id FROM d_out))"""
_D_ALL = "SELECT DISTINCT 0 AS g, sample_id FROM dv"


def _vector_frame(spark, sf):
    """Labelled documents that vectors were made for; one of them without its vector fails the job."""
    rows = pools.d_frame(spark, sf).where(pools.has_vector(spark, sf))
    return tables.join_vectors(rows, pools.d_vectors(spark, sf)).persist()


@query(
    "fit_embedding_ridge",
    "sample_id s, model s, pred 6",
    f"""WITH RECURSIVE {_D_VEC}, {ridge_sql('r', _D_ALL, _D_TARGET, _D_ALL, alpha='5', source='SELECT sample_id, feature, value FROM dv', d=64, scale=False)}
        SELECT sample_id, CASE t WHEN 1 THEN 'quality' ELSE 'toxic' END AS model, pred FROM r_pred""",
)
def fit_embedding_ridge(spark, sf):
    rows = _vector_frame(spark, sf)
    coefs = linear.fit(linear.moments(rows, "x", "score"), alpha=5.0, standardize=False)
    return _long(linear.score(rows, "x", coefs), _TWO)


# ---- tree, network and text learners: checked by their own properties, not by SQL ----------------------

# Chances, best single and oracle of the test rows do not depend on the learner; SQL knows them exactly.
_FIT_SPEC = "avg_score 6, random_score 6, best_single_score 6, oracle_score 6, best_single_model s, n_test i"
#: Fitted trees by application and tables: the queries about one model fit it once.
_FITTED: dict[tuple, object] = {}


def _split_frame(spark, sf, seed=42):
    frame, names = _mass_frame(spark, sf)
    return splits.id_split(frame, 0.7, seed, grouped=True).persist(), names


def _boosted(spark, sf):
    """The split frame, its feature names, and trees with the learner's own settings on its training rows."""
    frame, names = _split_frame(spark, sf)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        _FITTED[key] = boosting.fit(frame.where("partition = 'train'"))
    return frame, names, _FITTED[key]


@query("fit_gbt", _FIT_SPEC)
def fit_gbt(spark, sf):
    """Micro metrics of boosted trees for all candidates on a grouped split."""
    frame, _, model = _boosted(spark, sf)
    return experiments.evaluate(boosting.predict(frame.where("partition = 'test'"), model), frame.where("partition = 'train'"), MODELS)


@query("fit_random_forest", _FIT_SPEC)
def fit_random_forest(spark, sf):
    """Micro metrics of forests on a grouped split."""
    frame, _ = _split_frame(spark, sf)
    return experiments.train_evaluate(frame, MODELS, "random_forest")[1]


@query("fit_mlp", _FIT_SPEC)
def fit_mlp(spark, sf):
    """Micro metrics of the regression network on a grouped split."""
    frame, _ = _split_frame(spark, sf)
    return experiments.train_evaluate(frame, MODELS, "mlp")[1]


@query("fit_gbt_per_model", "model s, n i, mean_pred 6")
def fit_gbt_per_model(spark, sf):
    """Trees per candidate on its observed rows only."""
    frame = _gaps(_mass_frame(spark, sf)[0]).persist()
    rows = _long(boosting.predict(frame, boosting.fit(frame, shared=False)))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.avg("pred").alias("mean_pred"))


@query("feature_importance_sorted", "model s, feature s, importance 6")
def feature_importance_sorted(spark, sf):
    """Shares of the gains of the trees of `fit_gbt`."""
    _, names, model = _boosted(spark, sf)
    return boosting.importances(spark, model, names, MODELS)


@query("fit_tfidf_ridge", _FIT_SPEC)
def fit_tfidf_ridge(spark, sf):
    frame = splits.id_split(pools.d_frame(spark, sf), 0.7, 42, grouped=True).persist()
    return experiments.train_evaluate(frame, _TWO, "tfidf")[1]


@query("fit_embedding_gbt", _FIT_SPEC)
def fit_embedding_gbt(spark, sf):
    """Trees on embeddings of two label columns."""
    frame = splits.id_split(_vector_frame(spark, sf), 0.7, 42, grouped=True).persist()
    return experiments.train_evaluate(frame, _TWO, "gbt")[1]


# ---- experiments -------------------------------------------------------------------------------------

_MICRO = """SELECT avg(sel) AS avg_score, avg(rnd) AS random_score, avg(best) AS best_single_score, avg(orc) AS oracle_score,
    avg(sel) - avg(rnd) AS gain_over_random, avg(sel) - avg(best) AS gain_over_best_single, avg(orc) - avg(sel) AS gap_to_oracle,
    any_value(bs) AS best_single_model, count(*) AS n_test FROM ev"""
_MICRO_SPEC = "avg_score 6, random_score 6, best_single_score 6, oracle_score 6, gain_over_random 6, gain_over_best_single 6, gap_to_oracle 6, best_single_model s, n_test i"


def _eval_ctes(label: str = "part") -> str:
    return f"""top AS (SELECT sample_id, 'm' || t AS model FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pred DESC, t) AS rn FROM r_pred) WHERE rn = 1),
      bst AS (SELECT model FROM po JOIN {label} USING (sample_id) WHERE partition = 'train' GROUP BY model ORDER BY avg(score) DESC, model LIMIT 1),
      ev AS (SELECT o.sample_id, max(score) FILTER (o.model = t.model) AS sel, avg(score) AS rnd, max(score) AS orc,
        max(score) FILTER (o.model = (SELECT model FROM bst)) AS best, (SELECT model FROM bst) AS bs FROM po o JOIN top t USING (sample_id) GROUP BY o.sample_id)"""


@query(
    "train_evaluate",
    _MICRO_SPEC,
    f"""WITH RECURSIVE part AS ({_split_sql(42, 0.7, 'groups', 'leakage_group')}),
        {ridge_sql('r', "SELECT 0 AS g, sample_id FROM part WHERE partition = 'train'", _SCORES, "SELECT 0 AS g, sample_id FROM part WHERE partition = 'test'")}, {_eval_ctes()} {_MICRO}""",
)
def train_evaluate(spark, sf):
    frame, _ = _split_frame(spark, sf)
    return experiments.train_evaluate(frame, MODELS, "ridge")[1]


def _metrics_sql(pick: str) -> str:
    """Headline metrics of picks (sample_id, model) in pool P."""
    return f"""SELECT avg(router) * 100 AS AvgAcc, avg(CASE WHEN abs(rnd) > 1e-12 THEN router / rnd - 1 END) * 100 AS GainR,
        avg(CASE WHEN abs(best) > 1e-12 THEN router / best - 1 END) * 100 AS GainB, avg(CASE WHEN abs(orc) > 1e-12 THEN 1 - router / orc END) * 100 AS GapO,
        avg(best) * 100 AS BestSingleAvg, avg(dsbest) * 100 AS DatasetOracleAvg, avg(orc) * 100 AS OracleAvg, (SELECT model FROM dm_best) AS best_single_model,
        count(*) AS n_datasets, sum(n) AS n_test FROM (SELECT o.dataset, avg(o.score) AS router, count(*) AS n FROM {pick} k JOIN po o ON o.sample_id = k.sample_id AND o.model = k.model GROUP BY o.dataset)
        JOIN dm_x USING (dataset)"""


_TOP = "top AS (SELECT sample_id, 'm' || t AS model FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pred DESC, t) AS rn FROM r_pred) WHERE rn = 1)"


def _held_out_sql(cells: str, n: str) -> str:
    """Ridge trained without each cell; `cells` gives (sample_id, fold), `n` lists the folds."""
    return f"""fo AS ({cells}), ks AS ({n}), {ridge_sql('r', 'SELECT k AS g, sample_id FROM fo, ks WHERE fold <> k', 'SELECT k AS g, CAST(substr(model, 2) AS BIGINT) AS t, sample_id, score AS y FROM po, ks', 'SELECT fold AS g, sample_id FROM fo')}, {_TOP}"""


@query(
    "oof_evaluate",
    METRIC_SPEC,
    f"WITH RECURSIVE {_held_out_sql(_fold_sql(3407, 5, 'groups', 'leakage_group'), 'SELECT i AS k FROM range(0, 5) r(i)')} {_metrics_sql('top')}",
)
def oof_evaluate(spark, sf):
    frame = _mass_frame(spark, sf)[0].persist()
    return metrics.benchmark_metrics(frame, experiments.oof(frame, MODELS), MODELS)


@query(
    "ood_evaluate",
    f"protocol s, {METRIC_SPEC}",
    f"""WITH RECURSIVE {_held_out_sql("SELECT sample_id, dense_rank() OVER (ORDER BY domain) - 1 AS fold FROM ps", "SELECT DISTINCT dense_rank() OVER (ORDER BY domain) - 1 AS k FROM ps")}
        SELECT 'domain-ood' AS protocol, * FROM ({_metrics_sql('top')})""",
)
def ood_evaluate(spark, sf):
    """Leave one domain out with the linear learner."""
    frame = _mass_frame(spark, sf)[0].persist()
    return experiments.ood_suite({"probability_mass": (frame, "ridge", {})}, MODELS, ("domain",))


@query("ood_suite", f"protocol s, system s, {METRIC_SPEC}")
def ood_suite(spark, sf):
    """Probability mass, all features and the task family alone, without each dataset and each domain."""
    frame = pools.p_frame(spark, sf).persist()
    fs = pools.p_features(frame)
    systems = {}
    for name, own in (
        ("probability_mass", features.representation(fs, "probability_mass", BACKEND)),
        ("full", features.representation(fs, "full", BACKEND)),
        ("domain_only", fs.take(features.feature_set_names(fs.names, "domain_only", BACKEND))),
    ):
        systems[name] = (features.join_features(frame, own).persist(), "ridge", {})
    return experiments.ood_suite(systems, MODELS)


@query("embedding_oof", "sample_id s, fold i, selected_model s, selected_score 6",
    f"""WITH RECURSIVE {_D_VEC}, {_D_GROUPS}, dl AS (SELECT * FROM dg WHERE sample_id IN (SELECT sample_id FROM dv)), fo AS ({_fold_sql(3407, 5, 'dl', 'leakage_group')}), ks AS (SELECT i AS k FROM range(0, 5) r(i)),
        {ridge_sql('r', 'SELECT k AS g, sample_id FROM fo, ks WHERE fold <> k', "SELECT k AS g, CASE model WHEN 'quality' THEN 1 ELSE 2 END AS t, sample_id, score AS y FROM d_out, ks", 'SELECT fold AS g, sample_id FROM fo', alpha='5', source='SELECT sample_id, feature, value FROM dv', d=64, scale=False)}
        SELECT p.sample_id, p.g AS fold, CASE p.t WHEN 1 THEN 'quality' ELSE 'toxic' END AS selected_model, o.score AS selected_score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pred DESC, t) AS rn FROM r_pred) p
        JOIN d_out o ON o.sample_id = p.sample_id AND o.model = CASE p.t WHEN 1 THEN 'quality' ELSE 'toxic' END WHERE rn = 1""")
def embedding_oof(spark, sf):
    return experiments.oof(_vector_frame(spark, sf), _TWO, "embedding_ridge")


_SUITE_SPEC = "system s, n_seeds i, AvgAcc_mean 6, AvgAcc_std 6, GainR_mean 6, GainB_mean 6, GapO_mean 6, best_single_model s"


@query("representation_ablation", _SUITE_SPEC)
def representation_ablation(spark, sf):
    """Six representations under five seeds, from one scan."""
    frame = pools.p_frame(spark, sf).persist()
    wide, systems = experiments.representation_systems(pools.p_features(frame), BACKEND)
    rows, parts = experiments.with_partitions(features.join_features(frame, wide), experiments.SEEDS)
    rows, runs = experiments.linear_slots(rows.persist(), MODELS, systems, parts)
    return metrics.seed_summary(metrics.slot_metrics(rows, MODELS, runs))


@query("grouped_rerun", f"{_SUITE_SPEC}, n_ids i")
def grouped_rerun(spark, sf):
    """The linear systems of the grouped main protocol under five seeds, with the size of their common support."""
    frame = pools.p_frame(spark, sf).persist()
    table = experiments.grouped_rerun(frame, pools.p_features(frame), MODELS, BACKEND)
    sizes = table["support"].groupBy("system").agg(F.sum("n_ids").alias("n_ids"))
    return table["summary"].join(sizes, "system")


_PROBES = [*BINARY_PROBES, *SCORE_PROBES]
_SYSTEMS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(["all_probes", *[f"drop_{p}" for p in _PROBES]]))
_LOPO_MASK = f"g % 100 = 0 OR list_position([{', '.join(repr(p) for p in _PROBES)}], regexp_extract(feature, '^sem_(.*?)__', 1)) <> g % 100"


def _each_seed(label: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i * 100} + k.k AS g, sample_id FROM part{s}, range(0, 17) k(k) WHERE partition = '{label}'" for i, s in enumerate(experiments.SEEDS)
    )


_PARTS = ", ".join(f"part{s} AS ({_split_sql(s, 0.7, 'groups', 'leakage_group')})" for s in experiments.SEEDS)


_LOPO = f"""WITH RECURSIVE {_PARTS},
    gg AS (SELECT i.i * 100 + k.k AS g FROM range(0, {len(experiments.SEEDS)}) i(i), range(0, 17) k(k)),
    {ridge_sql('r', _each_seed('train'), 'SELECT g, CAST(substr(model, 2) AS BIGINT) AS t, sample_id, score AS y FROM po, gg', _each_seed('test'), mask=_LOPO_MASK)},
    tp AS (SELECT g, sample_id, 'm' || t AS model FROM (SELECT *, row_number() OVER (PARTITION BY g, sample_id ORDER BY pred DESC, t) AS rn FROM r_pred) WHERE rn = 1),
    sel AS (SELECT g, dataset, avg(score) AS router FROM tp JOIN po USING (sample_id, model) GROUP BY ALL),
    tst AS (SELECT DISTINCT g // 100 AS s, sample_id FROM tp),
    tdm AS (SELECT s, dataset, model, avg(score) AS acc FROM tst JOIN po USING (sample_id) GROUP BY ALL),
    tor AS (SELECT s, dataset, avg(oracle) AS orc FROM tst JOIN p_oracle USING (sample_id) GROUP BY ALL),
    tbest AS (SELECT s, model FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY a DESC, model) AS rn FROM (SELECT s, model, avg(acc) AS a FROM tdm GROUP BY ALL)) WHERE rn = 1),
    tx AS (SELECT d.s, d.dataset, avg(acc) AS rnd, max(acc) FILTER (d.model = b.model) AS best, any_value(b.model) AS bm_name FROM tdm d JOIN tbest b ON b.s = d.s GROUP BY d.s, d.dataset),
    one AS (SELECT g % 100 AS k, g // 100 AS s, avg(router) * 100 AS acc, avg(router / rnd - 1) * 100 AS gr, avg(router / best - 1) * 100 AS gb, avg(1 - router / orc) * 100 AS go, any_value(bm_name) AS bn
      FROM sel JOIN tx ON tx.s = g // 100 AND tx.dataset = sel.dataset JOIN tor ON tor.s = g // 100 AND tor.dataset = sel.dataset GROUP BY g)
    SELECT n.name AS system, count(*) AS n_seeds, avg(acc) AS AvgAcc_mean, stddev_samp(acc) AS AvgAcc_std, avg(gr) AS GainR_mean, avg(gb) AS GainB_mean, avg(go) AS GapO_mean,
      mode(bn ORDER BY bn) AS best_single_model, (SELECT avg(acc) FROM one WHERE k = 0) - avg(acc) AS drop_vs_all_pp FROM one JOIN (VALUES {_SYSTEMS}) n(k, name) ON n.k = one.k GROUP BY n.name"""


@query("leave_one_probe_out", f"{_SUITE_SPEC}, drop_vs_all_pp 6", _LOPO)
def leave_one_probe_out(spark, sf):
    frame, names = _mass_frame(spark, sf)
    rows, parts = experiments.with_partitions(frame, experiments.SEEDS)
    rows, runs = experiments.linear_slots(rows.persist(), MODELS, experiments.probe_systems(names, BACKEND), parts)
    return experiments.drop_effects(metrics.seed_summary(metrics.slot_metrics(rows, MODELS, runs)))


@query("learner_ablation", _SUITE_SPEC)
def learner_ablation(spark, sf):
    """Five learners under five seeds, each with its own settings."""
    frame, _ = _mass_frame(spark, sf)
    rows, parts = experiments.with_partitions(frame, experiments.SEEDS)
    learners = {"ols": {}, "ridge": {}, "gbt": {}, "random_forest": {}, "mlp": {}}
    rows, runs = experiments.learner_slots(rows.persist(), MODELS, parts, learners)
    return metrics.seed_summary(metrics.slot_metrics(rows, MODELS, runs))


@query("nested_probe_selection", "outer_fold i, probe s, rank i, selected b, contribution_pp 6, inner_all_avgacc 6, inner_drop_avgacc 6")
def nested_probe_selection(spark, sf):
    frame, names = _mass_frame(spark, sf)
    return experiments.nested_probe_selection(frame.persist(), names, MODELS, BACKEND)[0]


@query("nested_probe_metrics", f"system s, {METRIC_SPEC}")
def nested_probe_metrics(spark, sf):
    """All probes against the twelve kept in each outer fold."""
    frame, names = _mass_frame(spark, sf)
    frame = frame.persist()
    _, rows, runs = experiments.nested_probe_selection(frame, names, MODELS, BACKEND)
    return metrics.slot_metrics(rows, MODELS, runs)


@query(
    "nested_probe_test",
    "macro_diff_pp 6, bootstrap_ci_low_pp 6, bootstrap_ci_high_pp 6, permutation_p_two_sided 6, margin_pp 4, lower_one_sided_pp 6, noninferior_A_to_B b, n_queries i, n_datasets i, n_inference_clusters i",
)
def nested_probe_test(spark, sf):
    """The twelve probes kept in each outer fold against all of them: two-sided test and one-sided bound from the same replicates."""
    frame, names = _mass_frame(spark, sf)
    _, rows, runs = experiments.nested_probe_selection(frame.persist(), names, MODELS, BACKEND)
    return paired.slot_test(rows, runs.names.index(("lite",)), runs.names.index(("full",)))


_OOD_SPEC = "domain s, safe_model s, threshold 6, calibration_coverage 6, calibration_score 6, test_coverage 6, test_score 6, router_only_score 6, best_single_score 6, oracle_score 6, n_fit i, n_calibration i, n_test i"


_GRID = ", ".join(f"{0.5 + 0.5 * i / 100}::DOUBLE" for i in range(101))
def _domain_ood(seed: int) -> str:
    return f"""WITH RECURSIVE dms AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS g FROM (SELECT DISTINCT domain FROM ps)),
    lab AS (SELECT g, sample_id, CASE WHEN rn <= {_share('n', 0.8)} THEN 'fit' ELSE 'calibration' END AS label FROM (
        SELECT dms.g, s.sample_id, row_number() OVER (PARTITION BY dms.g, s.dataset ORDER BY {h_text(str(seed), 's.sample_id')}) AS rn, count(*) OVER (PARTITION BY dms.g, s.dataset) AS n
        FROM ps s JOIN dms ON s.domain <> dms.domain) UNION ALL SELECT g, sample_id, 'test' FROM ps JOIN dms USING (domain)),
    {ridge_sql('r', "SELECT g, sample_id FROM lab WHERE label = 'fit'", 'SELECT g, CAST(substr(model, 2) AS BIGINT) AS t, sample_id, score AS y FROM po, (SELECT g FROM dms) q', "SELECT g, sample_id FROM lab WHERE label <> 'fit'")},
    safe AS (SELECT g, model FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY a DESC, model) AS rn FROM (SELECT g, model, avg(score) AS a FROM lab JOIN po USING (sample_id) WHERE label = 'fit' GROUP BY ALL)) WHERE rn = 1),
    tp AS (SELECT g, sample_id, 'm' || t AS model FROM (SELECT *, row_number() OVER (PARTITION BY g, sample_id ORDER BY pred DESC, t) AS rn FROM r_pred) WHERE rn = 1),
    rt AS (SELECT l.g, l.sample_id, l.label, round(e.uncertainty, 9) AS u, a.score AS r, f.score AS f, o.oracle AS orc FROM lab l JOIN tp USING (g, sample_id)
        JOIN po a ON a.sample_id = l.sample_id AND a.model = tp.model JOIN safe ON safe.g = l.g JOIN po f ON f.sample_id = l.sample_id AND f.model = safe.model
        JOIN pf_entropy e ON e.sample_id = l.sample_id JOIN p_oracle o ON o.sample_id = l.sample_id),
    cal AS (SELECT * FROM rt WHERE label = 'calibration'), tau AS (SELECT DISTINCT g, unnest(quantile_cont(u, [{_GRID}])) AS tau FROM cal GROUP BY g),
    swp AS (SELECT g, tau, avg(CASE WHEN u <= tau THEN 1.0 ELSE 0.0 END) AS cov, avg(CASE WHEN u <= tau THEN r ELSE f END) AS sc FROM cal JOIN tau USING (g) GROUP BY g, tau),
    cho AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(sc, 12) DESC, cov DESC, tau) AS rn FROM swp WHERE cov + 1e-12 >= 0.5) WHERE rn = 1)
    SELECT domain, any_value(safe.model) AS safe_model, any_value(tau) AS threshold, any_value(cov) AS calibration_coverage, any_value(sc) AS calibration_score,
      avg(CASE WHEN u <= tau THEN 1.0 ELSE 0.0 END) AS test_coverage, avg(CASE WHEN u <= tau THEN r ELSE f END) AS test_score, avg(r) AS router_only_score, avg(f) AS best_single_score,
      avg(orc) AS oracle_score, (SELECT count(*) FROM lab x WHERE x.g = rt.g AND x.label = 'fit') AS n_fit, (SELECT count(*) FROM cal x WHERE x.g = rt.g) AS n_calibration, count(*) AS n_test
    FROM rt JOIN cho ON cho.g = rt.g JOIN safe ON safe.g = rt.g JOIN dms ON dms.g = rt.g WHERE label = 'test' GROUP BY rt.g, domain"""


@query("calibrated_domain_ood", _OOD_SPEC, _domain_ood(3407))
def calibrated_domain_ood(spark, sf, seed=3407):
    frame, _ = _mass_frame(spark, sf)
    domains = sorted(r[0] for r in frame.select("domain").distinct().collect())
    # Nine decimals: entropies are sums in varying order, and thresholds compare them.
    entropy = pools.entropy_table(frame).withColumn("uncertainty", F.round("uncertainty", 9))
    return experiments.calibrated_domain_ood(frame, entropy, MODELS, domains, seed=seed)


def _of_seeds(sql, seeds) -> str:
    return " UNION ALL ".join(f"SELECT {s} AS seed, * FROM ({sql(s)})" for s in seeds)


@query(
    "calibrated_summary",
    "n_seeds i, test_score_mean_pct 6, test_score_std_pct 6, router_only_mean_pct 6, router_only_std_pct 6, coverage_mean_pct 6, coverage_std_pct 6",
    f"""WITH d AS ({_of_seeds(_domain_ood, experiments.SEEDS)}),
       s AS (SELECT seed, avg(test_score) AS ts, avg(router_only_score) AS rs, avg(test_coverage) AS cov FROM d GROUP BY seed)
       SELECT count(*) AS n_seeds, avg(ts) * 100 AS test_score_mean_pct, stddev_samp(ts) * 100 AS test_score_std_pct, avg(rs) * 100 AS router_only_mean_pct,
         stddev_samp(rs) * 100 AS router_only_std_pct, avg(cov) * 100 AS coverage_mean_pct, stddev_samp(cov) * 100 AS coverage_std_pct FROM s""",
)
def calibrated_summary(spark, sf):
    """Calibrated domain holdouts under every seed."""
    # A row per domain.
    runs = [summary(calibrated_domain_ood(spark, sf, s)).withColumn("seed", F.lit(s)) for s in experiments.SEEDS]
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    return selective.calibrated_seed_summary(selective.domain_macro(rows, ("seed",)))


# ---- cost protocols ------------------------------------------------------------------------------------

_N = len(MODELS)
_COST_SPEC = (
    "baseline_model s, baseline_AvgAcc 6, baseline_total_cost 2, PerfGain_pct 6, CostSave_pct 6, CostSave_raw_pct 6, theta_star_lambda 4, "
    "theta_star_AvgAcc 6, theta_star_total_cost 2, theta_dagger_lambda 4, theta_dagger_AvgAcc 6, theta_dagger_total_cost 2, theta_dagger_test_meets_baseline b"
)


def _cost_predictions(p: str, train: str, apply: str) -> str:
    """{p}_qc (sample_id, model, q, c): quality groups 1..7 with penalty 1, cost groups 11..17 with penalty 2."""
    target = f"SELECT t AS g, t, sample_id, score AS y FROM sparse UNION ALL SELECT t + 10, t, sample_id, cost FROM sparse"
    rows = f"SELECT s.t + x.o AS g, s.sample_id FROM sparse s JOIN ({train}) tr ON tr.sample_id = s.sample_id, (VALUES (0), (10)) x(o)"
    every = f"SELECT m.t + x.o AS g, a.sample_id FROM ({apply}) a, (SELECT DISTINCT t FROM sparse) m, (VALUES (0), (10)) x(o)"
    return f"""{ridge_sql(p, rows, target, every, alpha='CASE WHEN g > 10 THEN 2 ELSE 1 END')},
      {p}_qc AS (SELECT sample_id, 'm' || t AS model, max(pred) FILTER (g < 10) AS q, greatest(0, max(pred) FILTER (g > 10)) AS c FROM {p}_pred GROUP BY sample_id, t)"""


def _cost_sweep(p: str, evaluated: str, bounds: str) -> str:
    """{p}_sw per lambda and {p}_base of the evaluated samples; `bounds` gives (sample_id) of the scaling rows."""
    return f"""{p}_ev AS ({evaluated}), {p}_bd AS (SELECT min(q) AS ql, max(q) AS qh, min(c) AS cl, max(c) AS ch FROM {p}_qc WHERE sample_id IN ({bounds})),
      {p}_u AS (SELECT s.sample_id, s.dataset, s.model, s.score, s.cost, l.i / 20.0::DOUBLE AS lambda,
        (1 - l.i / 20.0::DOUBLE) * ((q - ql) / greatest(qh - ql, 1e-12)) - l.i / 20.0::DOUBLE * ((c - cl) / greatest(ch - cl, 1e-12)) AS u
        FROM sparse s JOIN {p}_ev USING (sample_id) JOIN {p}_qc USING (sample_id, model), {p}_bd, range(0, 21) l(i)),
      {p}_pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, lambda ORDER BY u DESC, model) AS rn FROM {p}_u) WHERE rn = 1),
      {p}_sw AS (SELECT lambda, avg(a) AS acc, sum(tc) AS tc FROM (SELECT lambda, dataset, avg(score) AS a, sum(cost) AS tc FROM {p}_pk GROUP BY ALL) GROUP BY lambda),
      {p}_base AS (SELECT avg(a) AS bacc, sum(tc) AS bcost FROM (SELECT dataset, avg(score) AS a, sum(cost) AS tc FROM sparse JOIN {p}_ev USING (sample_id) WHERE model = 'm1' GROUP BY dataset))"""


def _points(sel: str, tst: str) -> str:
    return f"""star AS (SELECT lambda FROM {sel}_sw ORDER BY acc DESC, lambda LIMIT 1), dag AS (SELECT lambda FROM {sel}_sw, {sel}_base WHERE acc >= bacc - 1e-12 ORDER BY tc, lambda LIMIT 1)
      SELECT 'm1' AS baseline_model, bacc * 100 AS baseline_AvgAcc, bcost AS baseline_total_cost, (s.acc / bacc - 1) * 100 AS PerfGain_pct,
        CASE WHEN d.acc >= bacc - 1e-12 THEN (1 - d.tc / bcost) * 100 END AS CostSave_pct, (1 - d.tc / bcost) * 100 AS CostSave_raw_pct,
        s.lambda AS theta_star_lambda, s.acc * 100 AS theta_star_AvgAcc, s.tc AS theta_star_total_cost, d.lambda AS theta_dagger_lambda,
        d.acc * 100 AS theta_dagger_AvgAcc, d.tc AS theta_dagger_total_cost, d.acc >= bacc - 1e-12 AS theta_dagger_test_meets_baseline
      FROM {tst}_base b JOIN {tst}_sw s ON s.lambda = (SELECT lambda FROM star) LEFT JOIN {tst}_sw d ON d.lambda = (SELECT lambda FROM dag)"""


_SUPPORTED = "SELECT sample_id FROM sparse WHERE model = 'm1'"
_COST_PART = f"sparse AS ({_SPARSE}), sm AS (SELECT * FROM groups WHERE sample_id IN (SELECT sample_id FROM sparse))"


def _cost_frame(spark, sf):
    frame, _ = _mass_frame(spark, sf)
    return _gaps(frame).where(F.exists("score", lambda v: v.isNotNull())).persist()


@query(
    "perf_cost_eval",
    _COST_SPEC,
    f"""WITH RECURSIVE {_COST_PART}, part AS ({_split_sql(3407, 0.7, 'sm', 'leakage_group')}), tst AS (SELECT sample_id FROM part WHERE partition = 'test' AND sample_id IN ({_SUPPORTED})),
        {_cost_predictions('a', "SELECT sample_id FROM part WHERE partition = 'train'", 'SELECT sample_id FROM tst')},
        {_cost_sweep('a', 'SELECT sample_id FROM tst', 'SELECT sample_id FROM tst')}, {_points('a', 'a')}""",
)
def perf_cost_eval(spark, sf):
    frame = splits.id_split(_cost_frame(spark, sf), 0.7, 3407, grouped=True).persist()
    return experiments.perf_cost_eval(frame, MODELS, "m1")[0]


def _validated(seed: int) -> str:
    return f"""WITH RECURSIVE {_COST_PART}, ou AS ({_split_sql(seed, 0.7, 'sm', 'leakage_group')}), tr AS (SELECT * FROM sm WHERE sample_id IN (SELECT sample_id FROM ou WHERE partition = 'train')),
        inn AS ({_split_sql(seed + splits.INNER_SEED_STEP, 0.8, 'tr', 'leakage_group', 'inner_fit', 'validation')}),
        vfit AS (SELECT sample_id FROM inn WHERE partition = 'inner_fit'), val AS (SELECT sample_id FROM inn WHERE partition = 'validation'), tst AS (SELECT sample_id FROM ou WHERE partition = 'test'),
        {_cost_predictions('v', 'SELECT sample_id FROM vfit', 'SELECT sample_id FROM vfit UNION ALL SELECT sample_id FROM val')},
        {_cost_sweep('v', f'SELECT sample_id FROM val WHERE sample_id IN ({_SUPPORTED})', 'SELECT sample_id FROM vfit')},
        {_cost_predictions('e', 'SELECT sample_id FROM tr', 'SELECT sample_id FROM tr UNION ALL SELECT sample_id FROM tst')},
        {_cost_sweep('e', f'SELECT sample_id FROM tst WHERE sample_id IN ({_SUPPORTED})', 'SELECT sample_id FROM tr')}, {_points('v', 'e')}"""


@query("perf_cost_eval_validated", _COST_SPEC, _validated(3407))
def perf_cost_eval_validated(spark, sf, seed=3407):
    frame = splits.nested_split(_cost_frame(spark, sf), seed=seed).persist()
    return experiments.perf_cost_eval_validated(frame, MODELS, "m1")[0]


@query(
    "cost_seed_summary",
    "PerfGain_pct_mean 6, PerfGain_pct_std 6, positive_PerfGain_seeds i, strict_CostSave_reported_seeds i, positive_strict_CostSave_seeds i",
    f"""WITH r AS ({_of_seeds(_validated, experiments.COST_SEEDS)})
       SELECT avg(PerfGain_pct) AS PerfGain_pct_mean, stddev_samp(PerfGain_pct) AS PerfGain_pct_std, count(*) FILTER (PerfGain_pct > 0) AS positive_PerfGain_seeds,
         count(CostSave_pct) AS strict_CostSave_reported_seeds, count(*) FILTER (CostSave_pct > 0) AS positive_strict_CostSave_seeds FROM r""",
)
def cost_seed_summary(spark, sf):
    """The validated protocol under every cost seed."""
    # One row each.
    runs = [summary(perf_cost_eval_validated(spark, sf, s)) for s in experiments.COST_SEEDS]
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    return cost.seed_summary(rows)


@query("perf_cost_eval_trees", _COST_SPEC)
def perf_cost_eval_trees(spark, sf):
    """The protocol with boosted trees per candidate as the quality model."""
    frame = splits.id_split(_cost_frame(spark, sf), 0.7, 3407, grouped=True).persist()
    return experiments.perf_cost_eval(frame, MODELS, "m1", learner="gbt")[0]


# ---- batch and streaming routes --------------------------------------------------------------------------

_ROUTE = f"""WITH RECURSIVE {ridge_sql('r', _ALL, _SCORES, _ALL)}, rk AS (SELECT sample_id, 'm' || t AS model, pred, row_number() OVER (PARTITION BY sample_id ORDER BY pred DESC, t) AS rn FROM r_pred)"""


@query(
    "route_batch",
    "sample_id s, dataset s, domain s, rank i, model s, predicted_score 6, observed_score 6",
    f"{_ROUTE} SELECT k.sample_id, o.dataset, o.domain, rn AS rank, k.model, pred AS predicted_score, o.score AS observed_score FROM rk k JOIN po o ON o.sample_id = k.sample_id AND o.model = k.model WHERE rn <= 5",
)
def route_batch(spark, sf):
    """Published samples to ranked candidates with their observed scores, for all ids at once."""
    frame, names = _mass_frame(spark, sf)
    coefs = linear.fit(linear.moments(frame, "x", "score"))
    aligned = features.align(pools.p_mass(frame), names)
    rows = frame.select("sample_id", "dataset", "domain", "score").join(aligned.df, "sample_id")
    return routing.ranked(linear.score(rows, "x", coefs), MODELS, 5)


@query(
    "stream_route",
    "sample_id s, rank i, model s, predicted_score 6",
    f"{_ROUTE} SELECT sample_id, rn AS rank, model, pred AS predicted_score FROM rk WHERE rn <= 3",
)
def stream_route(spark, sf):
    """Feature rows arriving as files, routed row by row into a growing table."""
    frame, names = _mass_frame(spark, sf)
    coefs = linear.fit(linear.moments(frame, "x", "score"))
    source, out = scratch_path(spark, "arriving"), scratch_path(spark, "routed")
    pools.p_mass(frame).df.repartition(4).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = live.route(live.scan_stream(spark, source, schema), coefs, MODELS, 3)
    live.sink(stream, out, scratch_path(spark, "route-log"), available_now=True).awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_outcome_monitor",
    "start s, candidate s, n i, mean_score 6, least 6, most 6",
    """WITH w AS (SELECT date_trunc('day', ts) AS d, event_type AS candidate, count(*) AS n, avg(value) AS mean_score, min(value) AS least, max(value) AS most FROM events WHERE ts IS NOT NULL GROUP BY ALL)
       SELECT strftime(d, '%Y-%m-%d') AS start, candidate, n, mean_score, least, most FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def stream_outcome_monitor(spark, sf):
    """Daily outcomes per event type, emitted as the watermark closes the days."""
    source, out = scratch_path(spark, "events"), scratch_path(spark, "monitored")
    events = pools.table(spark, sf, "events")
    events.write.parquet(source)
    windows = monitor.outcome_monitor(live.scan_stream(spark, source, events.schema), "ts", "event_type", "value")
    live.sink(windows, out, scratch_path(spark, "monitor-log"), available_now=True).awaitTermination()
    return spark.read.schema(windows.schema).parquet(out).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("reproduce_all", "experiment s, metric s, value 6")
def reproduce_all(spark, sf):
    """The grouped protocol for two backends, all seeds and draws."""
    frame = pools.p_frame(spark, sf).persist()
    second = features.FeatureSet(pools.p_features(frame.withColumn("key", F.col("key") + 1)).df, features.probe_feature_names("alt"))
    sets = {BACKEND: pools.p_features(frame), "alt": second}
    return experiments.reproduce_all(
        frame.drop("score", "cost"), pools.p_outcomes(spark, sf), sets, MODELS
    )


@query("abstention_from_ood", "coverage 4, selector s, score 6, std 6")
def abstention_from_ood(spark, sf):
    """Abstention controls on leave-one-domain-out picks, against the candidate that is best outside the domain."""
    frame, _ = _mass_frame(spark, sf)
    frame = frame.persist()
    picks = experiments.ood(frame, MODELS, "domain").select("sample_id", F.col("selected_score").alias("router_score"))
    safe = routing.best_elsewhere(frame, MODELS, "domain")
    rows = join_checked(frame, safe, "domain").select("sample_id", "domain", F.element_at("score", F.col("best")).alias("fallback_score"))
    rows = rows.join(picks, "sample_id")
    rows = rows.join(pools.entropy_table(frame), "sample_id")
    return selective.abstention_macro(selective.abstention_controls(rows))


del np
