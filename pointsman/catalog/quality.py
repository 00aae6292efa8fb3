"""Queries: aggregations, windows, ranking, routing policies and metrics (pools P and O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointsman.catalog import pools
from pointsman.catalog.registry import query
from pointsman.catalog.sql import COST_SCALE, MODELS, N_MODELS, SEEDS, SYSTEMS, h, unit
from pointsman.functions import numeric, text
from pointsman.operators import audits, cost, dedup, matrix, metrics, paired, routing, selective
from pointsman.sources import tables

METRIC_SPEC = "AvgAcc 6, GainR 6, GainB 6, GapO 6, BestSingleAvg 6, DatasetOracleAvg 6, OracleAvg 6, best_single_model s, n_datasets i, n_test i"


def _slots(spark, sf):
    """Rows with the picks of all runs side by side, the candidates, and the runs' names."""
    rows = pools.p_frame(spark, sf)
    picks = F.array(*[routing.first_best(pools.unit_array(s, n, F.col("sample_id"))) for s in SEEDS for n in SYSTEMS])
    names = [(s, n) for s in SEEDS for n in SYSTEMS]
    return rows.select("sample_id", "dataset", "score", picks.alias("slots")), MODELS, metrics.Runs(names, ("seed", "system"))


def _picks(spark, sf):
    return routing.selected(pools.all_predictions(pools.p_frame(spark, sf)), MODELS)


def _first(spark, sf):
    return routing.selected(pools.with_predictions(pools.p_frame(spark, sf)).drop("pred_cost"), MODELS)


# ---- aggregations over outcomes -------------------------------------------------------


@query("complete_case_filter", "sample_id s", "SELECT sample_id FROM p_ids")
def complete_case_filter(spark, sf):
    return matrix.complete_samples(pools.p_raw_outcomes(spark, sf))


@query(
    "semi_keep_complete",
    "sample_id s, model s, score 6, cost 4",
    "SELECT sample_id, model, score, cost FROM p_raw WHERE sample_id IN (SELECT sample_id FROM p_ids)",
)
def semi_keep_complete(spark, sf):
    rows = pools.p_raw_outcomes(spark, sf)
    return matrix.keep_complete(rows, matrix.complete_samples(rows))


@query(
    "dataset_count_audit",
    "dataset s, expected i, actual i, delta i",
    """SELECT dataset, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(actual, 0) - coalesce(expected, 0) AS delta FROM
       (SELECT regexp_replace(lower(dataset), '[\\s-]+', '_', 'g') AS dataset, count(*) AS actual FROM ps GROUP BY ALL)
       FULL OUTER JOIN (SELECT lower(p_brand) AS dataset, count(*) AS expected FROM part GROUP BY ALL
         UNION ALL SELECT 'absent', 3) USING (dataset)""",
)
def dataset_count_audit(spark, sf):
    expected = pools.table(spark, sf, "part").groupBy(F.lower("p_brand").alias("dataset")).agg(F.count("*").alias("expected"))
    absent = spark.createDataFrame([("absent", 3)], "dataset string, expected long")
    return audits.dataset_counts(pools.p_samples(spark, sf), expected.unionByName(absent))


@query(
    "identity_count_audit",
    "dataset s, n_models i, records_min_model i, records_max_model i, origin_query_union i, prompt_union i, prompt_minus_origin i",
    """WITH r AS (SELECT lower(dataset) AS dataset, model, query AS origin_query, query || ' v' || CAST(key % 3 AS VARCHAR) AS prompt
         FROM p_raw JOIN p_samples USING (sample_id)),
       c AS (SELECT dataset, model, count(*) AS n FROM r GROUP BY ALL)
       SELECT dataset, count(*) AS n_models, min(n) AS records_min_model, max(n) AS records_max_model,
         any_value(o) AS origin_query_union, any_value(p) AS prompt_union, any_value(p) - any_value(o) AS prompt_minus_origin
       FROM c JOIN (SELECT dataset, count(DISTINCT origin_query) AS o, count(DISTINCT prompt) AS p FROM r GROUP BY dataset) USING (dataset) GROUP BY dataset""",
)
def identity_count_audit(spark, sf):
    rows = pools.p_raw_outcomes(spark, sf).join(pools.p_all_samples(spark, sf), "sample_id")
    prompt = F.concat("query", F.lit(" v"), (F.col("key") % 3).cast("string"))
    return audits.identity_counts(rows.select("dataset", "model", F.col("query").alias("origin_query"), prompt.alias("prompt")))


@query(
    "record_index_alignment",
    "problem s, model s, index s",
    """WITH r AS (SELECT 'm' || l_linenumber AS model, CAST(l_partkey AS VARCHAR) AS idx FROM lineitem GROUP BY ALL),
       f AS (SELECT min(model) AS m1 FROM r), models AS (SELECT DISTINCT model FROM r),
       miss AS (SELECT 'missing' AS problem, m.model, a.idx AS "index" FROM (SELECT idx FROM r WHERE model = (SELECT m1 FROM f)) a, models m
         WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.model = m.model AND r.idx = a.idx)),
       extra AS (SELECT 'extra' AS problem, model, idx AS "index" FROM r WHERE idx NOT IN (SELECT idx FROM r WHERE model = (SELECT m1 FROM f))),
       both_ AS (SELECT * FROM miss UNION ALL SELECT * FROM extra)
       SELECT problem, model, "index" FROM (SELECT *, row_number() OVER (PARTITION BY problem, model ORDER BY "index") AS rn FROM both_) WHERE rn <= 20
       UNION ALL SELECT 'missing_model', 'm8', NULL""",
)
def record_index_alignment(spark, sf):
    records = pools.p_raw_outcomes(spark, sf).select("model", F.col("sample_id").alias("index"))
    return audits.index_alignment(records, [*MODELS, "m8"])


@query(
    "support_matrix",
    "dataset s, model s, expected i, actual i",
    f"""WITH grid AS (SELECT dataset, 'm' || i AS model, count(*) AS expected FROM p_samples, range(1, {N_MODELS + 1}) r(i)
         WHERE NOT (dataset = 'Brand#1' AND i = 7) GROUP BY ALL),
       seen AS (SELECT dataset, model, count(DISTINCT sample_id) AS actual FROM p_raw JOIN p_samples USING (sample_id) GROUP BY ALL)
       SELECT dataset, model, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM grid FULL OUTER JOIN seen USING (dataset, model)""",
)
def support_matrix(spark, sf):
    samples = pools.p_all_samples(spark, sf)
    outcomes = pools.p_raw_outcomes(spark, sf).join(samples.select("sample_id", "dataset"), "sample_id")
    hole = (F.col("dataset") == "Brand#1") & (F.col("model") == "m7")
    return audits.support_matrix(outcomes, samples, MODELS, hole)


@query(
    "model_coverage",
    "model s, test_available i, test_coverage_pct 6, train_available i",
    f"""WITH s AS (SELECT sample_id, {h("'part'", "sample_id")} % 10 < 7 AS train FROM os)
       SELECT m.model, count(oo.sample_id) FILTER (NOT train) AS test_available,
         100.0 * count(oo.sample_id) FILTER (NOT train) / (SELECT count(*) FROM s WHERE NOT train) AS test_coverage_pct,
         count(oo.sample_id) FILTER (train) AS train_available
       FROM s CROSS JOIN (SELECT DISTINCT model FROM oo) m LEFT JOIN oo ON oo.sample_id = s.sample_id AND oo.model = m.model GROUP BY m.model""",
)
def model_coverage(spark, sf):
    from pointsman.functions import draws

    train = draws.hash_int("part", F.col("sample_id")) % 10 < 7
    return cost.model_coverage(pools.o_frame(spark, sf), MODELS, train, ~train)


@query(
    "sink_tables",
    "model s, samples i",
    "SELECT model, count(DISTINCT sample_id) AS samples FROM po GROUP BY model",
)
def sink_tables(spark, sf):
    from pointsman.session import scratch_path

    path = scratch_path(spark, "tables")
    tables.sink_tables(pools.p_samples(spark, sf), pools.p_outcomes(spark, sf), path)
    return audits.model_sample_counts(spark.read.parquet(f"{path}/outcomes"))


@query(
    "pivot_outcome_matrix",
    "sample_id s, " + ", ".join(f"{m} 6" for m in MODELS),
    "SELECT sample_id, " + ", ".join(f"max(score) FILTER (model = '{m}') AS {m}" for m in MODELS) + " FROM po GROUP BY sample_id",
)
def pivot_outcome_matrix(spark, sf):
    arrays = matrix.outcome_arrays(pools.p_outcomes(spark, sf), MODELS)
    return matrix.wide_columns(matrix.require_dense(arrays, MODELS), MODELS)


@query(
    "best_single_train",
    "best_single_model s, mean_score 8",
    "SELECT model AS best_single_model, avg(score) AS mean_score FROM po GROUP BY model ORDER BY 2 DESC, 1 LIMIT 1",
)
def best_single_train(spark, sf):
    return metrics.best_single_train(pools.p_frame(spark, sf), MODELS)


@query("best_single_macro", "best_single_model s, best_single_avg 8", "SELECT model AS best_single_model, acc AS best_single_avg FROM dm_best")
def best_single_macro(spark, sf):
    return metrics.best_single_macro(metrics.dataset_model_means(pools.p_frame(spark, sf), MODELS), MODELS)


@query(
    "baseline_select_complete",
    "baseline_model s, baseline_acc 8, baseline_cost 2",
    """WITH f AS (SELECT * FROM p_raw JOIN p_samples USING (sample_id) WHERE sample_id IN (SELECT sample_id FROM p_raw WHERE model IN ('m2', 'm5'))
         AND sample_id IN (SELECT sample_id FROM p_raw WHERE model = 'm2') AND sample_id IN (SELECT sample_id FROM p_raw WHERE model = 'm5')),
       d AS (SELECT model, dataset, avg(score) AS acc, sum(cost) AS cost, count(*) AS n FROM f GROUP BY ALL)
       SELECT model AS baseline_model, avg(acc) AS baseline_acc, sum(cost) AS baseline_cost FROM d
       GROUP BY model HAVING sum(n) = (SELECT count(DISTINCT sample_id) FROM f) ORDER BY 2 DESC, 1 LIMIT 1""",
)
def baseline_select_complete(spark, sf):
    """On the samples where m2 and m5 are observed, other candidates have gaps."""
    arrays = matrix.outcome_arrays(pools.p_raw_outcomes(spark, sf), MODELS, ("score", "cost"))
    frame = pools.p_all_samples(spark, sf).join(arrays, "sample_id")
    return cost.select_baseline(frame.where(F.col("score")[1].isNotNull() & F.col("score")[4].isNotNull()), MODELS)


@query(
    "macro_accuracy",
    "seed i, system s, AvgAcc 8",
    "SELECT seed, system, avg(a) AS AvgAcc FROM (SELECT seed, system, dataset, avg(selected_score) AS a FROM pk GROUP BY ALL) GROUP BY ALL",
)
def macro_accuracy(spark, sf):
    return metrics.macro_accuracy(_picks(spark, sf), keys=("seed", "system"))


@query(
    "routing_metrics",
    "seed i, system s, avg_score 8, random_score 8, best_single_score 8, oracle_score 8, gain_over_random 8, gain_over_best_single 8, gap_to_oracle 8, normalized_oracle_gap 7, mean_regret 8, n_test i",
    """WITH b AS (SELECT model FROM po GROUP BY model ORDER BY avg(score) DESC, model LIMIT 1),
       f AS (SELECT avg(r) AS rnd, avg(orc) AS orc FROM (SELECT sample_id, avg(score) AS r, max(score) AS orc FROM po GROUP BY sample_id)),
       s AS (SELECT avg(score) AS best FROM po WHERE model = (SELECT model FROM b)),
       a AS (SELECT seed, system, avg(selected_score) AS v, avg(regret) AS reg, count(*) AS n FROM pk GROUP BY ALL)
       SELECT seed, system, v AS avg_score, rnd AS random_score, best AS best_single_score, orc AS oracle_score, v - rnd AS gain_over_random,
         v - best AS gain_over_best_single, orc - v AS gap_to_oracle, CASE WHEN orc - best > 1e-12 THEN (orc - v) / (orc - best) END AS normalized_oracle_gap,
         reg AS mean_regret, n AS n_test FROM a, f, s""",
)
def routing_metrics(spark, sf):
    frame = pools.p_frame(spark, sf)
    best = metrics.best_single_train(frame, MODELS).first().best_single_model
    rows = pools.all_predictions(frame)
    picks = rows.withColumn("selected_score", F.element_at("score", routing.first_best(F.col("pred"))))
    return metrics.routing_metrics(picks, MODELS, F.lit(best), ("seed", "system"))


@query("benchmark_metrics", f"seed i, system s, {METRIC_SPEC}", "SELECT * FROM bm")
def benchmark_metrics(spark, sf):
    """Flagship: headline metrics of every run in one job."""
    return metrics.slot_metrics(*_slots(spark, sf))


@query(
    "frozen_direct_eval",
    METRIC_SPEC,
    "SELECT * EXCLUDE (seed, system) FROM bm WHERE seed = 2 AND system = 'gamma'",
)
def frozen_direct_eval(spark, sf):
    """Stored predictions of one system, scored again."""
    frame = pools.p_frame(spark, sf)
    stored = routing.selected(pools.with_predictions(frame, 2, "gamma").drop("pred_cost"), MODELS)
    return metrics.benchmark_metrics(frame, stored, MODELS)


@query("dataset_oracle", "DatasetOracleAvg 8", "SELECT avg(a) AS DatasetOracleAvg FROM (SELECT dataset, max(acc) AS a FROM dm GROUP BY dataset)")
def dataset_oracle(spark, sf):
    per = metrics.dataset_model_means(pools.p_frame(spark, sf), MODELS)
    return per.agg(F.avg(F.array_max("means")).alias("DatasetOracleAvg"))


@query("instance_oracle", "OracleAvg 8", "SELECT avg(a) AS OracleAvg FROM (SELECT dataset, avg(oracle) AS a FROM p_oracle GROUP BY dataset)")
def instance_oracle(spark, sf):
    per = metrics.dataset_model_means(pools.p_frame(spark, sf), MODELS)
    return per.agg(F.avg("oracle").alias("OracleAvg"))


_SUMMARY = ", ".join(f"{m}_mean 6, {m}_std 6" for m in metrics.METRICS)


@query(
    "seed_summary",
    f"system s, n_seeds i, {_SUMMARY}, best_single_model s",
    "SELECT system, count(*) AS n_seeds, "
    + ", ".join(f"avg({m}) AS {m}_mean, coalesce(stddev_samp({m}), 0) AS {m}_std" for m in metrics.METRICS)
    + ", mode(best_single_model ORDER BY best_single_model) AS best_single_model FROM bm GROUP BY system",
)
def seed_summary(spark, sf):
    runs = metrics.slot_metrics(*_slots(spark, sf))
    return metrics.seed_summary(runs)


@query(
    "baseline_summary",
    "baseline s, definition s, AvgAcc_mean 6, AvgAcc_std 6",
    " UNION ALL ".join(
        f"SELECT '{k}' AS baseline, '{d}' AS definition, avg({c}) AS AvgAcc_mean, stddev_samp({c}) AS AvgAcc_std FROM bm WHERE system = 'alpha'"
        for k, (c, d) in metrics.BASELINES.items()
    ),
)
def baseline_summary(spark, sf):
    runs = metrics.slot_metrics(*_slots(spark, sf))
    return metrics.baseline_summary(runs.where("system = 'alpha'"))


@query(
    "main_table",
    f"system s, n_seeds i, {_SUMMARY}, best_single_model s, n_ids i, digest_0 i, digest_1 i, n_mismatches i",
    """WITH sup AS (SELECT seed, system, count(*) AS n, bit_xor(CAST('0x' || substr(md5(sample_id), 1, 8) AS BIGINT)) AS d0, bit_xor(CAST('0x' || substr(md5(sample_id), 9, 8) AS BIGINT)) AS d1 FROM pk GROUP BY ALL),
       part AS (SELECT seed, sample_id FROM pk GROUP BY ALL HAVING count(DISTINCT system) < (SELECT count(DISTINCT system) FROM runs)),
       sums AS (SELECT system, sum(n) AS n_ids, max(d0) AS digest_0, max(d1) AS digest_1, (SELECT count(*) FROM part) AS n_mismatches FROM sup GROUP BY system) """
    + "SELECT system, count(*) AS n_seeds, "
    + ", ".join(f"avg({m}) AS {m}_mean, coalesce(stddev_samp({m}), 0) AS {m}_std" for m in metrics.METRICS)
    + ", mode(best_single_model ORDER BY best_single_model) AS best_single_model, any_value(n_ids) AS n_ids, any_value(digest_0) AS digest_0, any_value(digest_1) AS digest_1,"
    " any_value(n_mismatches) AS n_mismatches FROM bm JOIN sums USING (system) GROUP BY system",
)
def main_table(spark, sf):
    from pointsman.plans import experiments

    rows, models, runs = _slots(spark, sf)
    t = experiments.main_table(rows, models, runs, "alpha")
    sums = t["support"].groupBy("system").agg(F.sum("n_ids").alias("n_ids"), F.max("digest_0").alias("digest_0"), F.max("digest_1").alias("digest_1"), F.sum("n_mismatches").alias("n_mismatches"))
    return t["summary"].join(sums, "system")


@query(
    "win_loss_tie",
    "wins i, losses i, ties i",
    "SELECT count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff = 0) AS ties FROM pd",
)
def win_loss_tie(spark, sf):
    return paired.difference(_paired(spark, sf)).select(
        F.col("query_wins").alias("wins"), F.col("query_losses").alias("losses"), F.col("query_ties").alias("ties")
    )


def _paired(spark, sf, grouped=False):
    frame = pools.p_frame(spark, sf)
    a = routing.selected(pools.with_predictions(frame, 1, "alpha").drop("pred_cost"), MODELS)
    b = routing.selected(pools.with_predictions(frame, 1, "beta").drop("pred_cost"), MODELS)
    return paired.paired_frame(frame, a, b, grouped)


# ---- windows and ranking ---------------------------------------------------------------


@query(
    "split_priority_dedup",
    "sample_id s, split s, first_pos i, model s, outcome_pos i, score 6",
    """WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, 'm' || l_linenumber AS model,
         CASE l_returnflag WHEN 'A' THEN 'test_3000' WHEN 'N' THEN 'v1' ELSE 'other' END AS split,
         CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 2 ELSE 0 END AS rank_,
         CAST(l_partkey * 1000 + l_suppkey AS BIGINT) AS pos, CAST(CAST(round(l_discount * 100) AS BIGINT) AS DOUBLE) / 10 AS score FROM lineitem),
       s AS (SELECT sample_id, split, pos FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rank_ DESC, split, model, pos, score) AS rn FROM r) WHERE rn = 1),
       o AS (SELECT sample_id, model, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, model ORDER BY rank_ DESC, split DESC, pos DESC, score DESC) AS rn FROM r) WHERE rn = 1)
       SELECT o.sample_id, s.split, s.pos AS first_pos, o.model, o.pos AS outcome_pos, o.score FROM o JOIN s USING (sample_id)""",
)
def split_priority_dedup(spark, sf):
    flag = F.col("l_returnflag")
    rows = pools.table(spark, sf, "lineitem").select(
        pools.text_id("l_orderkey"),
        F.concat(F.lit("m"), "l_linenumber").alias("model"),
        F.when(flag == "A", "test_3000").when(flag == "N", "v1").otherwise("other").alias("split"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"),
        (F.round(F.col("l_discount") * 100).cast("long").cast("double") / 10).alias("score"),
    )
    seq = [F.col(c) for c in ("split", "model", "pos", "score")]
    samples = dedup.samples_by_priority(rows, ["sample_id"], seq).select("sample_id", "split", F.col("pos").alias("first_pos"))
    outcomes = dedup.outcomes_by_priority(rows.drop("dataset"), ["sample_id", "model"], seq)
    return outcomes.select("sample_id", "model", F.col("pos").alias("outcome_pos"), "score").join(samples, "sample_id")


@query("drop_dup_keep_last", "sample_id s, model s, score 6, cost 4", "SELECT sample_id, model, score, cost FROM oo")
def drop_dup_keep_last(spark, sf):
    return pools.o_outcomes(spark, sf)


@query(
    "query_hash_conflict",
    "dataset s, n_models i",
    """SELECT dataset, count(DISTINCT size) AS n_models FROM (SELECT dataset || '/' || query AS dataset, size FROM p_samples) GROUP BY dataset HAVING count(DISTINCT sha256(CAST(size AS VARCHAR))) > 1""",
)
def query_hash_conflict(spark, sf):
    rows = pools.p_all_samples(spark, sf).select(
        F.concat("dataset", F.lit("/"), "query").alias("dataset"), "size", text.query_hash(F.col("size").cast("string")).alias("query_hash")
    )
    odd = dedup.hash_conflicts(rows, ["dataset"])
    return rows.join(odd, "dataset", "left_semi").groupBy("dataset").agg(F.count_distinct("size").alias("n_models"))


@query(
    "argmax_route",
    "seed i, system s, sample_id s, selected_model s",
    "SELECT seed, system, sample_id, selected_model FROM pk",
)
def argmax_route(spark, sf):
    return _picks(spark, sf)


@query(
    "route_quality",
    "sample_id s, selected_model s, pred 8",
    """SELECT sample_id, model AS selected_model, q AS pred FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY q DESC, model) AS rn FROM
       (SELECT sample_id, model, floor(q * 4) AS q FROM pr WHERE seed = 1 AND system = 'alpha')) WHERE rn = 1""",
)
def route_quality(spark, sf):
    """From a long prediction table with many ties."""
    rows = pools.with_predictions(pools.p_frame(spark, sf)).select("sample_id", F.posexplode("pred").alias("i", "q"))
    long = rows.select("sample_id", F.element_at(F.array(*[F.lit(m) for m in MODELS]), F.col("i") + 1).alias("model"), F.floor(F.col("q") * 4).cast("double").alias("pred"))
    return routing.pick_long(long)


@query("prediction_margin", "seed i, system s, sample_id s, prediction_margin 8", "SELECT seed, system, sample_id, prediction_margin FROM pk")
def prediction_margin(spark, sf):
    return _picks(spark, sf)


@query(
    "selected_frame",
    "sample_id s, selected_model s, selected_score 6, oracle_score 6, regret 6, prediction_margin 8",
    "SELECT * FROM pk WHERE seed = 1 AND system = 'alpha'",
)
def selected_frame(spark, sf):
    return _first(spark, sf)


@query(
    "selected_frame_cost",
    "sample_id s, dataset s, selected_model s, selected_score 6, selected_cost 4, available_models i",
    """SELECT sample_id, dataset, model AS selected_model, score AS selected_score, cost AS selected_cost, n AS available_models FROM (
       SELECT o.*, row_number() OVER (PARTITION BY sample_id ORDER BY q DESC, model) AS rn, count(*) OVER (PARTITION BY sample_id) AS n
       FROM oo o JOIN opr USING (sample_id, model)) WHERE rn = 1""",
)
def selected_frame_cost(spark, sf):
    return routing.selected_with_cost(pools.o_predicted(spark, sf), MODELS)


@query(
    "availability_mask",
    "sample_id s, model s, score 6, cost 4, n_available i",
    "SELECT sample_id, model, score, cost, count(*) OVER (PARTITION BY sample_id) AS n_available FROM oo WHERE score IS NOT NULL AND cost IS NOT NULL",
)
def availability_mask(spark, sf):
    frame = pools.o_frame(spark, sf).withColumn("n_available", routing.available(F.col("score"), F.col("cost")))
    both = F.arrays_zip(F.array(*[F.lit(m) for m in MODELS]).alias("model"), F.col("score").alias("score"), F.col("cost").alias("cost"))
    rows = frame.select("sample_id", "n_available", F.explode(both).alias("o")).select("sample_id", "n_available", "o.*")
    return rows.where(numeric.is_finite(F.col("score")) & numeric.is_finite(F.col("cost")))


@query(
    "baseline_supported_subset",
    "sample_id s, dataset s, supported b",
    "SELECT sample_id, dataset, sample_id IN (SELECT sample_id FROM oo WHERE model = 'm3') AS supported FROM os",
)
def baseline_supported_subset(spark, sf):
    return cost.baseline_supported(pools.o_frame(spark, sf), MODELS, "m3")


@query(
    "evaluation_included_flag",
    "sample_id s, partition s, evaluation_included b",
    f"""SELECT sample_id, CASE WHEN train THEN 'train' ELSE 'test' END AS partition,
         train OR sample_id IN (SELECT sample_id FROM oo WHERE model = 'm3') AS evaluation_included
       FROM (SELECT sample_id, {h("'part'", "sample_id")} % 10 < 7 AS train FROM os)""",
)
def evaluation_included_flag(spark, sf):
    from pointsman.functions import draws

    frame = cost.baseline_supported(pools.o_frame(spark, sf), MODELS, "m3")
    train = draws.hash_int("part", F.col("sample_id")) % 10 < 7
    return frame.withColumn("partition", F.when(train, "train").otherwise("test")).withColumn(
        "evaluation_included", (F.col("partition") == "train") | F.col("supported")
    )


@query(
    "topk_ranking",
    "sample_id s, rank i, model s, predicted_score 8",
    """SELECT sample_id, rn AS rank, model, q AS predicted_score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY q DESC, model) AS rn
       FROM pr WHERE seed = 1 AND system = 'alpha') WHERE rn <= 5""",
)
def topk_ranking(spark, sf):
    return routing.ranked(pools.with_predictions(pools.p_frame(spark, sf)), MODELS, 5)


@query(
    "join_observed_score",
    "sample_id s, rank i, model s, predicted_score 8, observed_score 6",
    """SELECT sample_id, rn AS rank, model, q AS predicted_score, score AS observed_score FROM (
       SELECT o.sample_id, o.model, o.q, x.score, row_number() OVER (PARTITION BY o.sample_id ORDER BY o.q DESC, o.model) AS rn
       FROM opr o LEFT JOIN oo x ON x.sample_id = o.sample_id AND x.model = o.model) WHERE rn <= 3""",
)
def join_observed_score(spark, sf):
    return routing.ranked(pools.o_predicted(spark, sf), MODELS, 3)


@query(
    "macro_weights",
    "sample_id s, weight 10",
    "SELECT sample_id, 1.0::DOUBLE / ((SELECT count(DISTINCT dataset) FROM pd) * count(*) OVER (PARTITION BY dataset)) AS weight FROM pd",
)
def macro_weights(spark, sf):
    return paired.with_macro_weights(_paired(spark, sf))


@query(
    "rank_probes",
    "outer_fold i, probe s, contribution_pp 8, rank i, selected b",
    """SELECT outer_fold, probe, contribution_pp, row_number() OVER (PARTITION BY outer_fold ORDER BY contribution_pp DESC, position) AS rank,
         row_number() OVER (PARTITION BY outer_fold ORDER BY contribution_pp DESC, position) <= 12 AS selected FROM (
       SELECT l_linenumber AS outer_fold, p_brand AS probe, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) % 7 AS DOUBLE) / 4 AS contribution_pp,
         CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS position FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)""",
)
def rank_probes(spark, sf):
    """Contributions with many ties: brands stand for probes, line numbers for outer folds."""
    rows = pools.table(spark, sf, "lineitem").join(pools.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    table = rows.groupBy(F.col("l_linenumber").alias("outer_fold"), F.col("p_brand").alias("probe")).agg(
        ((F.sum(F.round(F.col("l_discount") * 100).cast("long")) % 7).cast("double") / 4).alias("contribution_pp")
    )
    return routing.probe_ranks(table.withColumn("position", F.regexp_extract("probe", "[0-9]+", 0).cast("long")), 12)


@query(
    "probe_selection_frequency",
    "probe s, selected_folds i, mean_rank 8, mean_contribution_pp 8, std_contribution_pp 8, selection_frequency 8",
    """WITH c AS (SELECT l_linenumber AS outer_fold, p_brand AS probe, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) % 7 AS DOUBLE) / 4 AS contribution_pp,
         CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS position FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY contribution_pp DESC, position) AS rn FROM c)
       SELECT probe, count(*) FILTER (rn <= 12) AS selected_folds, avg(rn) AS mean_rank, avg(contribution_pp) AS mean_contribution_pp,
         stddev_samp(contribution_pp) AS std_contribution_pp, count(*) FILTER (rn <= 12) / 7.0::DOUBLE AS selection_frequency FROM r GROUP BY probe""",
)
def probe_selection_frequency(spark, sf):
    from pointsman.plans.experiments import selection_frequency

    return selection_frequency(rank_probes(spark, sf), 7)


# ---- selective routing -----------------------------------------------------------------

_COVERAGES = "(VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.85::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) c(c)"
_CURVE = f"""SELECT k / CAST(n AS DOUBLE) AS coverage, avg(regret) AS risk, any_value(k) AS n FROM (
    SELECT *, row_number() OVER (ORDER BY u, md5(sample_id)) AS rn FROM src) r,
    (SELECT c, greatest(1, CAST(round_even(n * c, 0) AS BIGINT)) AS k, n FROM {_COVERAGES}, (SELECT count(*) AS n FROM src)) WHERE rn <= k GROUP BY c, k, n"""
_ENTROPY_SRC = "src AS (SELECT sample_id, regret, round(uncertainty, 9) AS u FROM pk JOIN pf_entropy USING (sample_id) WHERE seed = 1 AND system = 'alpha')"
_MARGIN_SRC = "src AS (SELECT sample_id, regret, -prediction_margin AS u FROM pk WHERE seed = 1 AND system = 'alpha')"
_AURC = """SELECT sum((coverage - lc) * (risk + lr) / 2) AS aurc FROM (SELECT coverage, risk, lag(coverage) OVER (ORDER BY coverage) AS lc,
    lag(risk) OVER (ORDER BY coverage) AS lr FROM curve)"""


def _uncertain(spark, sf):
    frame = pools.p_frame(spark, sf)
    picks = routing.selected(pools.with_predictions(frame).drop("pred_cost"), MODELS)
    # Nine decimals: sums run in another order in another engine, and ranks must agree.
    entropy = pools.entropy_table(frame).withColumn("uncertainty", F.round("uncertainty", 9))
    return picks.join(entropy, "sample_id").persist()


@query("selective_entropy_curve", "coverage 8, risk 8, n i", f"WITH {_ENTROPY_SRC} {_CURVE}")
def selective_entropy_curve(spark, sf):
    return selective.risk_coverage_curve(_uncertain(spark, sf), "uncertainty")


@query("selective_margin_curve", "coverage 8, risk 8, n i", f"WITH {_MARGIN_SRC} {_CURVE}")
def selective_margin_curve(spark, sf):
    return selective.risk_coverage_curve(_first(spark, sf).withColumn("u", -F.col("prediction_margin")), "u")


@query("risk_coverage_curve", "coverage 8, risk 8, n i", f"WITH src AS (SELECT sample_id, regret, oracle_score AS u FROM pk WHERE seed = 1 AND system = 'alpha') {_CURVE}")
def risk_coverage_curve(spark, sf):
    """Ordered by a value with very many ties."""
    return selective.risk_coverage_curve(_first(spark, sf), "oracle_score")


@query("aurc", "aurc 8", f"WITH {_MARGIN_SRC}, curve AS ({_CURVE}) {_AURC}")
def aurc(spark, sf):
    return selective.aurc(selective_margin_curve(spark, sf))


_ROUTE_SRC = """src AS (SELECT k.sample_id, k.domain, round(e.uncertainty, 9) AS u, k.selected_score AS r, f.score AS f FROM pk k
    JOIN pf_entropy e USING (sample_id) JOIN po f ON f.sample_id = k.sample_id AND f.model = 'm1' WHERE k.seed = 1 AND k.system = 'alpha')"""


def _routed(spark, sf):
    frame = pools.p_frame(spark, sf)
    entropy = pools.entropy_table(frame).withColumn("uncertainty", F.round("uncertainty", 9))
    rows = pools.with_predictions(frame).join(entropy, "sample_id")
    return rows.select(
        "sample_id", "domain", "uncertainty",
        F.element_at("score", routing.first_best(F.col("pred"))).alias("router_score"),
        F.col("score")[0].alias("fallback_score"),
    ).persist()


@query(
    "select_threshold",
    "threshold 8, coverage 8, score 8",
    f"""WITH {_ROUTE_SRC}, g AS (SELECT DISTINCT (SELECT quantile_cont(u, 0.5 + 0.5 * i / 100.0) FROM src) AS tau FROM range(0, 101) t(i)),
       s AS (SELECT tau, avg(CASE WHEN u <= tau THEN 1.0 ELSE 0.0 END) AS cov, avg(CASE WHEN u <= tau THEN r ELSE f END) AS sc FROM src, g GROUP BY tau)
       SELECT tau AS threshold, cov AS coverage, sc AS score FROM s WHERE cov + 1e-12 >= 0.5 ORDER BY round(sc, 12) DESC, cov DESC, tau LIMIT 1""".replace(
        "(SELECT quantile_cont(u, 0.5 + 0.5 * i / 100.0) FROM src) AS tau FROM range(0, 101) t(i)",
        "unnest(quantile_cont(u, [" + ", ".join(f"{0.5 + 0.5 * i / 100}::DOUBLE" for i in range(101)) + "])) AS tau FROM src",
    ),
)
def select_threshold(spark, sf):
    return selective.select_threshold(_routed(spark, sf))


@query(
    "route_or_abstain",
    "sample_id s, score 6, routed b",
    f"""WITH {_ROUTE_SRC}, t AS (SELECT quantile_cont(u, 0.7) AS tau FROM src)
       SELECT sample_id, CASE WHEN u <= tau THEN r ELSE f END AS score, u <= tau AS routed FROM src, t""",
)
def route_or_abstain(spark, sf):
    from pointsman.operators.ranking import exact_quantiles

    rows = _routed(spark, sf)
    tau = exact_quantiles(rows, "uncertainty", [0.7]).select(F.col("value").alias("tau"))
    both = rows.join(F.broadcast(tau))
    return both.withColumn("routed", F.col("uncertainty") <= F.col("tau")).withColumn(
        "score", routing.route_or_abstain(F.col("uncertainty"), F.col("tau"), F.col("router_score"), F.col("fallback_score"))
    )


#: The operator's own number of random draws.
_REPEATS = 1000
_ABSTAIN = f"""WITH {_ROUTE_SRC}, cv AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) c(coverage)),
    kk AS (SELECT domain, coverage, CAST(round_even(n * coverage, 0) AS BIGINT) AS k FROM cv, (SELECT domain, count(*) AS n FROM src GROUP BY domain)),
    ranked AS (
      SELECT domain, r, f, 'semantic_entropy' AS selector, 0 AS rep, row_number() OVER (PARTITION BY domain ORDER BY u, md5(sample_id)) AS rn FROM src
      UNION ALL SELECT domain, r, f, 'oracle', 0, row_number() OVER (PARTITION BY domain ORDER BY f - r, md5(sample_id)) FROM src
      UNION ALL SELECT domain, r, f, 'random', i, row_number() OVER (PARTITION BY domain, i ORDER BY md5(concat_ws(':', 3407, i, sample_id))) FROM src, range(0, {_REPEATS}) t(i)),
    one AS (SELECT domain, coverage, selector, rep, avg(CASE WHEN rn <= k THEN r ELSE f END) AS v FROM ranked JOIN kk USING (domain) GROUP BY ALL),
    ctl AS (SELECT domain, coverage, selector, avg(v) AS score, coalesce(stddev_samp(v), 0) AS std FROM one GROUP BY ALL)"""


@query("abstention_controls", "domain s, coverage 4, selector s, score 8, std 8", f"{_ABSTAIN} SELECT * FROM ctl")
def abstention_controls(spark, sf):
    return selective.abstention_controls(_routed(spark, sf), random_repeats=_REPEATS)


@query("abstention_macro", "coverage 4, selector s, score 8, std 8", f"{_ABSTAIN} SELECT coverage, selector, avg(score) AS score, avg(std) AS std FROM ctl GROUP BY ALL")
def abstention_macro(spark, sf):
    return selective.abstention_macro(selective.abstention_controls(_routed(spark, sf), random_repeats=_REPEATS))


# ---- quality and cost --------------------------------------------------------------------

_BOUNDS = "b AS (SELECT min(q) AS qmin, max(q) AS qmax, min(c) AS cmin, max(c) AS cmax FROM opr)"
_LAMS = "lam AS (SELECT i / 20.0::DOUBLE AS lambda FROM range(0, 21) t(i))"
_SWEEP_PICK = f"""{_BOUNDS}, {_LAMS}, u AS (SELECT o.sample_id, o.dataset, o.model, o.score, o.cost, lambda,
      (1.0::DOUBLE - lambda) * ((q - qmin) / greatest(qmax - qmin, 1e-12)) - lambda * ((c - cmin) / greatest(cmax - cmin, 1e-12)) AS util
      FROM oo o JOIN opr p USING (sample_id, model), b, lam),
    pick AS (SELECT sample_id, dataset, lambda, model AS selected_model, score AS selected_score, cost AS selected_cost, n AS available_models FROM (
      SELECT *, row_number() OVER (PARTITION BY sample_id, lambda ORDER BY util DESC, model) AS rn, count(*) OVER (PARTITION BY sample_id, lambda) AS n FROM u) WHERE rn = 1)"""
_SWEEP = f"""{_SWEEP_PICK}, sw AS (SELECT lambda, (SELECT avg(a) FROM (SELECT avg(selected_score) AS a FROM pick q2 WHERE q2.lambda = p.lambda GROUP BY dataset)) AS AvgAcc,
      sum(selected_cost) AS total_cost, avg(selected_cost) AS mean_cost, min(available_models) AS min_available_models, avg(available_models) AS mean_available_models
      FROM pick p GROUP BY lambda)"""


def _sweep(spark, sf, rows=None):
    rows = rows if rows is not None else pools.o_predicted(spark, sf).persist()
    bounds = routing.global_bounds(rows, ["pred", "pred_cost"])
    return cost.sweep_metrics(cost.sweep_picks(rows, MODELS, bounds))


@query(
    "lambda_grid_cross",
    "lambda 4, n_rows i, n_samples i",
    f"WITH {_LAMS} SELECT lambda, count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples FROM oo, lam GROUP BY lambda",
)
def lambda_grid_cross(spark, sf):
    # Outcomes lie together by sample, so their samples are counted where they are.
    per_sample = cost.lambda_grid(pools.o_outcomes(spark, sf)).groupBy("sample_id", "lambda").agg(F.count("*").alias("n"))
    return per_sample.groupBy("lambda").agg(F.sum("n").alias("n_rows"), F.count("sample_id").alias("n_samples"))


@query(
    "route_cost_masked",
    "sample_id s, lambda 4, selected_model s, selected_score 6, selected_cost 4, available_models i",
    f"WITH {_SWEEP_PICK} SELECT * FROM pick",
)
def route_cost_masked(spark, sf):
    rows = pools.o_predicted(spark, sf).persist()
    return cost.sweep_picks(rows, MODELS, routing.global_bounds(rows, ["pred", "pred_cost"]))


@query(
    "lambda_sweep",
    "lambda 4, AvgAcc 8, total_cost 3, mean_cost 6, min_available_models i, mean_available_models 8, pareto b",
    f"""WITH {_SWEEP} SELECT *, NOT EXISTS (SELECT 1 FROM sw o WHERE o.AvgAcc >= p.AvgAcc AND o.total_cost <= p.total_cost
        AND (o.AvgAcc > p.AvgAcc OR o.total_cost < p.total_cost)) AS pareto FROM sw p""",
)
def lambda_sweep(spark, sf):
    return cost.pareto_flags(_sweep(spark, sf))


@query(
    "cost_totals",
    "lambda 4, total_cost 3, mean_cost 6, min_available_models i, mean_available_models 8",
    f"WITH {_SWEEP} SELECT * FROM sw",
)
def cost_totals(spark, sf):
    return _sweep(spark, sf)


@query(
    "pareto_frontier",
    "lambda 4, AvgAcc 8, total_cost 3",
    f"""WITH {_SWEEP} SELECT * FROM sw p WHERE NOT EXISTS (SELECT 1 FROM sw o WHERE o.AvgAcc >= p.AvgAcc AND o.total_cost <= p.total_cost
        AND (o.AvgAcc > p.AvgAcc OR o.total_cost < p.total_cost))""",
)
def pareto_frontier(spark, sf):
    return cost.pareto_flags(_sweep(spark, sf)).where("pareto").orderBy("total_cost", "AvgAcc")


@query(
    "self_join_pareto",
    "sample_id s, model s, score 6, cost 4, pareto b",
    """WITH best AS (SELECT cost, max(score) AS top FROM po GROUP BY cost),
       lim AS (SELECT cost, top, max(top) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM best)
       SELECT sample_id, model, score, po.cost, score = top AND (below IS NULL OR top > below) AS pareto FROM po JOIN lim ON lim.cost = po.cost""",
)
def self_join_pareto(spark, sf):
    """Every (sample, candidate) as a point."""
    return cost.pareto_flags(pools.p_outcomes(spark, sf), "score", "cost")


@query("theta_star", "lambda 4, AvgAcc 8, total_cost 3", f"WITH {_SWEEP} SELECT * FROM sw ORDER BY AvgAcc DESC, lambda LIMIT 1")
def theta_star(spark, sf):
    return cost.theta_star(_sweep(spark, sf))


_BASE = "base AS (SELECT avg(a) AS acc FROM (SELECT dataset, avg(score) AS a FROM oo GROUP BY dataset))"


@query(
    "theta_dagger",
    "lambda 4, AvgAcc 8, total_cost 3",
    f"WITH {_SWEEP}, {_BASE} SELECT sw.* FROM sw, base WHERE AvgAcc >= acc - 1e-12 ORDER BY total_cost, lambda LIMIT 1",
)
def theta_dagger(spark, sf):
    base = metrics.macro_accuracy(pools.o_outcomes(spark, sf), "score").first().AvgAcc
    return cost.theta_dagger(_sweep(spark, sf), F.lit(base))


@query(
    "perf_gain_cost_save",
    "lambda 4, PerfGain_pct 6, CostSave_pct 6",
    f"""WITH {_SWEEP}, {_BASE}, bc AS (SELECT sum(x) AS cost FROM (SELECT avg(cost) AS x FROM oo GROUP BY sample_id))
        SELECT lambda, (AvgAcc / acc - 1) * 100 AS PerfGain_pct, CASE WHEN AvgAcc >= acc - 1e-12 THEN (1 - total_cost / cost) * 100 END AS CostSave_pct FROM sw, base, bc""",
)
def perf_gain_cost_save(spark, sf):
    frame = pools.o_predicted(spark, sf).persist()
    outcomes = pools.o_observed(frame)
    acc = metrics.macro_accuracy(outcomes, "score").select(F.col("AvgAcc").alias("acc"))
    money = outcomes.groupBy("sample_id").agg(F.avg("cost").alias("x")).agg(F.sum("x").alias("base_cost"))
    rows = _sweep(spark, sf, frame).join(F.broadcast(acc)).join(F.broadcast(money))
    meets = F.col("AvgAcc") >= F.col("acc") - numeric.TINY
    return rows.withColumn("PerfGain_pct", cost.perf_gain(F.col("AvgAcc"), F.col("acc"))).withColumn(
        "CostSave_pct", F.when(meets, cost.cost_save(F.col("total_cost"), F.col("base_cost")))
    )


@query(
    "route_cost_aware",
    "sample_id s, lambda 4, selected_model s, selected_score 6",
    """WITH b AS (SELECT model, min(q) AS ql, max(q) AS qh, min(c) AS cl, max(c) AS ch FROM pr WHERE seed = 1 AND system = 'alpha' GROUP BY model),
       u AS (SELECT sample_id, model, score, lambda, (1.0::DOUBLE - lambda) * ((q - ql) / CASE WHEN qh > ql THEN qh - ql ELSE 1 END)
         - lambda * ((c - cl) / CASE WHEN ch > cl THEN ch - cl ELSE 1 END) AS util
         FROM pr JOIN b USING (model), (VALUES (0.0::DOUBLE), (0.3::DOUBLE)) l(lambda) WHERE seed = 1 AND system = 'alpha')
       SELECT sample_id, lambda, model AS selected_model, score AS selected_score FROM (
         SELECT *, row_number() OVER (PARTITION BY sample_id, lambda ORDER BY util DESC, model) AS rn FROM u) WHERE rn = 1""",
)
def route_cost_aware(spark, sf):
    frame = pools.with_predictions(pools.p_frame(spark, sf))
    out = None
    for lam in (0.0, 0.3):
        rows = routing.route_cost_aware(frame, MODELS, lam).select(
            "sample_id",
            F.lit(lam).alias("lambda"),
            routing.name_at(MODELS, F.col("slot")).alias("selected_model"),
            F.element_at("score", F.col("slot")).alias("selected_score"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


del COST_SCALE, unit
