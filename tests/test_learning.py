"""Learners and protocols against brute force on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointsman.operators import features, linear, metrics, paired, routing, selective, trees
from pointsman.operators.features import FeatureSet
from pointsman.plans import experiments

MODELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 240
    x = rng.random((n, 6))
    y = np.clip(x @ rng.normal(size=(6, 3)) + rng.normal(size=(n, 3)) * 0.2, 0, 1)
    rows = [
        (str(i), f"d{i % 4}", f"m{i % 3}", "same" if i % 20 == 0 else f"q{i}", x[i].tolist(), y[i].tolist()) for i in range(n)
    ]
    frame = spark.createDataFrame(rows, "sample_id string, dataset string, domain string, query string, x array<double>, score array<double>")
    return frame.persist(), x, y


def ridge(x, y, alpha, standardize=True):
    mean, dev = x.mean(0), x.std(0) if standardize else np.ones(x.shape[1])
    z = (x - mean) / dev
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean(0)))
    return lambda new: (new - mean) / dev @ w + y.mean(0)


def collected(rows, column="pred"):
    out = {int(r.sample_id): r[column] for r in rows.select("sample_id", column).collect()}
    return np.array([out[i] for i in sorted(out)])


def test_ridge_and_its_cells(spark, data):
    frame, x, y = data
    rows = frame.withColumn("cells", F.array((F.col("sample_id").cast("int") % 3).cast("int")))
    mo = linear.moments(rows, "x", "score", "cells")
    assert collected(linear.score(frame, "x", linear.fit(mo, 1.0))) == pytest.approx(ridge(x, y, 1.0)(x))
    without = linear.fit_without(mo, [0, 1, 2], alpha=1.0)
    train = np.arange(len(x)) % 3 != 1
    got = collected(linear.score(frame, "x", without[1]))
    assert got == pytest.approx(ridge(x[train], y[train], 1.0)(x))
    subset = linear.fit(mo, 1.0, keep=[0, 2, 5])
    assert collected(linear.score(frame, "x", subset)) == pytest.approx(ridge(x[:, [0, 2, 5]], y, 1.0)(x[:, [0, 2, 5]]))


def test_masked_ridge_uses_only_observed_rows(spark, data):
    frame, x, y = data
    hole = F.transform("score", lambda v, i: F.when((F.col("sample_id").cast("int") + i) % 4 != 0, v))
    coefs = linear.fit(linear.moments(frame.withColumn("score", hole), "x", "score", masked=True), 2.0)
    got = collected(linear.score(frame, "x", coefs))
    for j in range(3):
        seen = (np.arange(len(x)) + j) % 4 != 0
        assert got[:, j] == pytest.approx(ridge(x[seen], y[seen, j : j + 1], 2.0)(x)[:, 0])


def test_constant_feature_and_least_norm(spark, data):
    frame, x, y = data
    wide = frame.withColumn("x", F.concat("x", F.array(F.lit(3.0), F.col("x")[0])))
    coefs = linear.fit(linear.moments(wide, "x", "score"), 0.0)
    full = np.hstack([np.ones((len(x), 1)), x])
    want = full @ np.linalg.lstsq(full, y, rcond=None)[0]
    assert collected(linear.score(wide, "x", coefs)) == pytest.approx(want)


def test_save_and_load_keep_the_order(spark, data, tmp_path):
    frame, x, y = data
    coefs = linear.fit(linear.moments(frame, "x", "score"), 1.0)
    names, models = ["f5", "f1", "f4", "f0", "f3", "f2"], ["m2", "m1", "m3"]
    linear.save_router(spark, str(tmp_path / "router"), coefs, names, models)
    again, n2, m2 = linear.load_router(spark, str(tmp_path / "router"))
    assert (n2, m2) == (names, models) and again == pytest.approx(coefs)
    aligned = features.align(FeatureSet(frame.select("sample_id", "x"), names), names).df.limit(1)
    assert np.array(linear.score(aligned, "x", again).first().pred).shape == (3,)


def test_align_rejects_what_is_not_finite(spark):
    fs = FeatureSet(spark.createDataFrame([("a", [1.0, float("nan")])], "sample_id string, x array<double>"), ["f", "g"])
    with pytest.raises(Exception, match="not finite"):
        features.align(fs, ["g", "f"]).df.collect()
    with pytest.raises(ValueError):
        features.align(fs, ["h"])


def test_probability_mass_has_40_features():
    names = features.probe_feature_names("sem")
    assert len(features.representation_names(names, "probability_mass", "sem")) == 40


def test_hard_ties_and_missing_mass(spark):
    names = ["b_s__p__2", "b_s__p__10", "b_n__noul", "b_e__expected"]
    fs = FeatureSet(spark.createDataFrame([("a", [0.5, 0.5, 0.5, 2.5])], "sample_id string, x array<double>"), names)
    hard = features.representation(fs, "hard", "b")
    # Levels compare as text, so 10 comes before 2 and wins the tie; 2.5 rounds to even.
    assert dict(zip(hard.names, hard.df.first().x)) == {"b_s__hard": 10.0, "b_n__hard": 1.0, "b_e__hard": 2.0}


def test_out_of_fold_covers_each_sample_once(spark, data):
    frame, _, _ = data
    picks = experiments.oof(frame, MODELS, "ridge", 4, 11)
    assert picks.count() == picks.select("sample_id").distinct().count() == 240


def test_linear_suite_equals_single_runs(spark, data):
    frame, _, _ = data
    rows, parts = experiments.with_partitions(frame, (5, 6))
    runs = experiments.linear_suite(rows, MODELS, {"all": list(range(6)), "few": [1, 3]}, parts)
    got = {(r.seed, r.system, r.sample_id): r.selected_model for r in runs.collect()}
    for seed, col in parts.items():
        for system, keep in (("all", list(range(6))), ("few", [1, 3])):
            own = rows.withColumn("partition", F.col(col)).withColumn("x", F.array(*[F.col("x")[i] for i in keep]))
            for r in experiments.train_evaluate(own, MODELS, "ridge")[0].collect():
                assert got[(seed, system, r.sample_id)] == r.selected_model


def test_nested_selection_against_brute_force(spark, data):
    frame, x, y = data
    names = ["b_p__noul", "b_q__noul", "b_r__p__0", "b_r__p__1", "b_s__p__0", "b_s__p__1"]
    selection, rows, runs = experiments.nested_probe_selection(frame, names, MODELS, "b", keep=2, outer_folds=3, inner_folds=2, seed=5)
    from pointsman.operators import splits

    outer = {int(r.sample_id): r["fold"] for r in splits.stratified_folds(frame, 3, 5, True).collect()}
    out = np.array([outer[i] for i in range(240)])
    dataset = np.arange(240) % 4
    got = {(r.outer_fold, r.probe): r for r in selection.collect()}
    cols = {"p": [0], "q": [1], "r": [2, 3], "s": [4, 5]}
    for o in range(3):
        train = frame.where(F.col("sample_id").isin([str(i) for i in range(240) if out[i] != o]))
        inner = {int(r.sample_id): r["fold"] for r in splits.stratified_folds(train, 2, 5 + (o + 1) * experiments.INNER_FOLD_SEED_STEP, True).collect()}
        ids = np.array(sorted(inner))
        fold = np.array([inner[i] for i in ids])

        def accuracy(keep):
            score = np.empty(len(ids))
            for g in range(2):
                fit = ridge(x[ids[fold != g]][:, keep], y[ids[fold != g]], 1.0)
                te = ids[fold == g]
                score[fold == g] = y[te, np.argmax(fit(x[te][:, keep]), axis=1)]
            return np.mean([score[dataset[ids] == d].mean() for d in range(4)]) * 100

        base = accuracy(list(range(6)))
        for probe, own in cols.items():
            want = base - accuracy([i for i in range(6) if i not in own])
            assert got[(o, probe)].contribution_pp == pytest.approx(want, abs=1e-9)
    picks = metrics.slot_picks(rows, MODELS, runs)
    assert picks.groupBy("system").agg(F.count_distinct("sample_id").alias("n")).where("n = 240").count() == 2


def test_zero_weight_routes_by_quality(spark, data):
    frame, _, _ = data
    rows = linear.score(frame, "x", linear.fit(linear.moments(frame, "x", "score"))).withColumn("pred_cost", F.col("pred"))
    aware = routing.route_cost_aware(rows, MODELS, 0.0)
    scaled = aware.withColumn("plain", routing.first_best(F.col("value")))
    assert scaled.where("plain <> slot").count() == 0


@pytest.fixture(scope="module")
def paired_frame(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), f"d{i % 3}", f"q{i // 2}" if i % 5 == 0 else f"x{i}", float(rng.integers(0, 2)), float(rng.integers(0, 2))) for i in range(300)]
    s = spark.createDataFrame(rows, "sample_id string, dataset string, query string, a double, b double").persist()
    sides = [s.select("sample_id", F.col(c).alias("selected_score")) for c in ("a", "b")]
    return s, sides


@pytest.mark.parametrize("draw", ["hash", "counts"])
def test_both_ways_of_drawing_agree_with_theory(spark, paired_frame, draw):
    s, (a, b) = paired_frame
    frame = paired.paired_frame(s, a, b).persist()
    per = frame.groupBy("dataset").agg(F.var_pop("diff").alias("v"), F.count("*").alias("n")).collect()
    se = (sum(r.v / r.n for r in per) ** 0.5) / len(per)
    macro = paired.difference(frame).first().macro_diff
    reps = [r.macro for r in paired.bootstrap_replicates(paired.units(frame), 3000, 5, draw).collect()]
    assert np.mean(reps) == pytest.approx(macro, abs=se / 10) and np.std(reps) == pytest.approx(se, rel=0.08)
    c = np.array([r.contribution for r in paired.contributions(frame).collect()])
    stats = [r.stat for r in paired.permutation_stats(paired.contributions(frame), 3000, 5, draw).collect()]
    assert len(stats) == 3000 and np.std(stats) == pytest.approx(np.sqrt((c**2).sum()), rel=0.08)


def test_chunks_do_not_change_the_distribution(spark, paired_frame, monkeypatch):
    s, (a, b) = paired_frame
    u = paired.units(paired.paired_frame(s, a, b))
    monkeypatch.setattr(paired, "VALUES_PER_CHUNK", 1)
    reps = paired.bootstrap_replicates(u, 200, 5, "counts").collect()
    total = u.groupBy("dataset").count().collect()
    sizes = paired._count_bootstrap(u, 50, 5).groupBy("dataset", "replicate").agg(F.sum("size").alias("n"))
    want = {r.dataset: r["count"] for r in total}
    assert len(reps) == 200 and all(r.n == want[r.dataset] for r in sizes.collect())


def test_no_difference_gives_p_of_one(spark, paired_frame):
    s, (a, _) = paired_frame
    row = paired.prediction_test(s, a, a, n_bootstrap=20, n_permutations=64).first()
    assert row.permutation_p_two_sided == 1.0 and row.query_ties == 300 and row.bootstrap_ci_low == 0.0


def test_clusters_of_one_equal_no_clusters(spark, paired_frame):
    s, (a, b) = paired_frame
    unique = s.withColumn("query", F.col("sample_id"))
    plain = paired.contributions(paired.paired_frame(unique, a, b)).agg(F.sum("contribution")).first()[0]
    frame = paired.paired_frame(unique, a, b, grouped=True)
    assert paired.contributions(frame, True).agg(F.sum("contribution")).first()[0] == pytest.approx(plain)
    assert paired.units(frame, True).count() == 300


def test_unpaired_sample_fails(spark, paired_frame):
    s, (a, b) = paired_frame
    with pytest.raises(Exception, match="unpaired"):
        paired.difference(paired.paired_frame(s, a, b.where("sample_id <> '7'"))).collect()


def test_random_selector_moments_are_the_limit_of_its_draws(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame(
        [(str(i), f"d{i % 2}", float(rng.random()), float(rng.random()), float(rng.random())) for i in range(200)],
        "sample_id string, domain string, uncertainty double, router_score double, fallback_score double",
    )
    drawn = {(r.domain, r.coverage): r for r in selective.abstention_controls(rows, random_repeats=400).where("selector = 'random'").collect()}
    exact = {(r.domain, r.coverage): r for r in selective.abstention_controls(rows, random="moments").where("selector = 'random'").collect()}
    assert drawn.keys() == exact.keys()
    for k, r in exact.items():
        assert drawn[k].score == pytest.approx(r.score, abs=4 * r.std / 20 + 1e-9)
        assert drawn[k]["std"] == pytest.approx(r["std"], rel=0.2, abs=1e-9)


def test_tree_router_keeps_its_orders(spark, tmp_path):
    rows = [(str(i), [i / 4, 1 - i / 4], [i / 4, 1 - i / 4]) for i in range(4)]
    frame = spark.createDataFrame(rows, "sample_id string, x array<double>, score array<double>")
    fitted = trees.fit_per_candidate(frame, ["zeta", "Alpha"], "gbt", max_iter=2, depth=2)
    trees.save_router(spark, str(tmp_path / "router"), fitted, ["f2", "f1"], ["zeta", "Alpha"])
    loaded, names, models = trees.load_router(spark, str(tmp_path / "router"))
    assert (names, models) == (["f2", "f1"], ["zeta", "Alpha"])
    one = frame.limit(1)
    assert [len(r.pred) for r in trees.predict(one, loaded).collect()] == [2]
    assert np.allclose(collected(trees.predict(frame, loaded)), collected(trees.predict(frame, fitted)))


def test_best_elsewhere(spark, data):
    frame, _, y = data
    got = {r.domain: r.best for r in routing.best_elsewhere(frame, MODELS, "domain").collect()}
    part = np.arange(len(y)) % 3
    assert got == {f"m{k}": int(y[part != k].mean(0).argmax()) + 1 for k in range(3)}


def test_calibrated_holdouts_count_a_row_once(spark, monkeypatch):
    """Sums of a holdout are those of all cells but its own, with the few rows corrected whose label differs."""
    from pointsman.operators import splits

    rng = np.random.default_rng(4)
    n, domains = 600, [f"m{k}" for k in range(30)] + ["M1"]
    x = rng.random((n, 3))
    y = np.clip(x @ rng.normal(size=(3, 3)) + rng.normal(size=(n, 3)) * 0.2, 0, 1)
    # Nulls belong to no domain; m1 and M1 are left out together.
    domain = [None if i % 50 == 0 else "M1" if i % 60 == 1 else f"m{i % 30}" for i in range(n)]
    rows = [(str(i), f"d{i % 2}", domain[i], x[i].tolist(), y[i].tolist()) for i in range(n)]
    frame = spark.createDataFrame(rows, "sample_id string, dataset string, domain string, x array<double>, score array<double>")
    entropy = spark.createDataFrame([(str(i), float(rng.random())) for i in range(n)], "sample_id string, uncertainty double")
    sizes, moments = [], linear.moments

    def watched(rows, x, y, cells=None, **kw):
        sizes.append(rows.agg(F.avg(F.size(cells))).first()[0])
        return moments(rows, x, y, cells, **kw)

    monkeypatch.setattr(linear, "moments", watched)
    got = {r.domain: r for r in experiments.calibrated_domain_ood(frame, entropy, MODELS, domains).collect()}
    assert sizes[0] < 3
    joined = {r.domain: r for r in experiments.calibrated_domain_ood(frame.join(entropy, "sample_id"), None, MODELS, domains).collect()}
    assert set(joined) == set(got) == set(domains)
    labels = {int(r.sample_id): r.labels for r in splits.holdout_labels(frame, domains, 0.2, 3407).collect()}
    for k, d in enumerate(domains):
        fit, cal, test = ([i for i in range(n) if labels[i][k] == w] for w in ("fit", "calibration", "test"))
        assert test == [i for i in range(n) if (domain[i] or "").lower() == d.lower()]
        pred = ridge(x[fit], y[fit], 1.0)(x[test])
        safe = int(np.argmax(y[fit].mean(0)))
        for r in (got[d], joined[d]):
            assert (r.n_fit, r.n_calibration, r.n_test, r.safe_model) == (len(fit), len(cal), len(test), MODELS[safe])
            assert r.router_only_score == pytest.approx(np.mean(y[test, np.argmax(pred, axis=1)]))
            assert r.best_single_score == pytest.approx(np.mean(y[test, safe]))
