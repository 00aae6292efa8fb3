"""Network, sparse ridge and boosted trees against dense arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointsman.catalog import learning
from pointsman.catalog.load import QUERIES
from pointsman.operators import boosting, forests, network, sparse, tfidf, trees
from pointsman.plans import experiments

SCHEMA = "sample_id string, dataset string, domain string, query string, x array<double>, score array<double>"


def frame_of(spark, x, y):
    return spark.createDataFrame([(str(i), f"d{i % 3}", "m", f"q{i}", a.tolist(), [None if np.isnan(v) else float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))], SCHEMA)


def predictions(rows):
    out = {int(r.sample_id): r.pred for r in rows.select("sample_id", "pred").collect()}
    return np.array([out[i] for i in sorted(out)])


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    sizes = [4, 5, 3, 2]
    theta = network.start(sizes, 1)
    x, y = rng.normal(size=(30, 4)), rng.random((30, 2))
    y[3, 1] = np.nan
    g, _, seen = network.gradient(network.unflat(theta, sizes), x, y)
    assert seen == 59
    for k in rng.choice(len(theta), 25, replace=False):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        up, down = (network.gradient(network.unflat(theta + s, sizes), x, y)[1] for s in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7)


def test_network_learns_graded_scores(spark):
    """Scores between 0.6 and 0.8 would all be one class."""
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = np.stack([0.6 + 0.2 * x[:, 0] * x[:, 1], 0.7 - 0.1 * x[:, 2]], axis=1)
    frame = frame_of(spark, x, y).repartition(4)
    net = network.fit(frame, max_iter=150)
    got = predictions(network.predict(frame, net))
    assert np.abs(got - y).mean() < 0.02 and np.corrcoef(got[:, 0], y[:, 0])[0, 1] > 0.95


def test_training_stops_early(spark):
    rng = np.random.default_rng(2)
    frame = frame_of(spark, rng.random((200, 3)), rng.random((200, 1)))
    assert network.fit(frame, patience=3).steps < 100
    with pytest.raises(ValueError):
        network.fit(frame.limit(0))


def test_sparse_ridge_against_a_dense_solution(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((120, 25)) < 0.2, rng.random((120, 25)), 0.0)
    y = rng.random((120, 2))
    y[::7, 1] = np.nan
    rows = spark.createDataFrame(
        [(str(i), np.nonzero(a)[0].tolist(), a[a != 0].tolist(), [None if np.isnan(v) else float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))],
        "sample_id string, slots array<int>, values array<double>, score array<double>",
    ).repartition(3)
    fitted = sparse.fit(rows, 25, alpha=5.0)
    for j in range(2):
        seen = ~np.isnan(y[:, j])
        c = x[seen] - x[seen].mean(0)
        w = np.linalg.solve(c.T @ c + 5.0 * np.eye(25), c.T @ (y[seen, j] - y[seen, j].mean()))
        assert fitted.weights[:, j] == pytest.approx(w, abs=1e-6)
        assert fitted.bias[j] == pytest.approx(y[seen, j].mean() - x[seen].mean(0) @ w, abs=1e-6)
    got = predictions(sparse.predict(rows, fitted))
    assert got == pytest.approx(x @ fitted.weights + fitted.bias)


def test_text_ridge_ranks_by_words(spark):
    texts = [("good " if i % 2 else "poor ") + f"word{i % 5} text number{i % 11}" for i in range(80)]
    rows = spark.createDataFrame([(str(i), "d", "m", t, [float(i % 2), 0.5]) for i, t in enumerate(texts)], "sample_id string, dataset string, domain string, query string, score array<double>")
    got = predictions(experiments.fit_predict(rows, rows, ["a", "b"], "tfidf"))
    assert (got[1::2, 0] > 0.6).all() and (got[::2, 0] < 0.4).all() and got[:, 1] == pytest.approx(np.full(80, 0.5))


def brute(x, y, rounds, depth, step, l2):
    """Trees with one question per level, by trying every border of every feature on plain arrays."""
    borders = [np.unique(c)[:-1] for c in x.T]
    pred = np.tile(y.mean(0), (len(x), 1))
    for _ in range(rounds):
        r, leaf = y - pred, np.zeros(len(x), int)
        for level in range(depth):
            best = (-1.0, None)
            for f, bs in enumerate(borders):
                for b in bs:
                    split = leaf + ((x[:, f] > b).astype(int) << level)
                    score = sum((r[split == q].sum(0) ** 2).sum() / ((split == q).sum() + l2) for q in np.unique(split))
                    if score > best[0] * (1 + 1e-9):
                        best = (score, split)
            leaf = best[1]
        for q in np.unique(leaf):
            pred[leaf == q] += step * r[leaf == q].sum(0) / ((leaf == q).sum() + l2)
    return pred


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (90, 3)).astype(float)
    y = np.stack([np.sin(x[:, 0]) + 0.3 * x[:, 1] + rng.normal(size=90) * 0.1, x[:, 2] * (x[:, 0] > 2)], axis=1)
    return x, y


def test_trees_against_brute_force(spark, small, monkeypatch):
    """Shared trees, with states written every second round."""
    monkeypatch.setattr(boosting, "KEEP", 2)
    x, y = small
    frame = frame_of(spark, x, y).repartition(3)
    model = boosting.fit(frame, max_iter=5, depth=3, step=0.3)
    assert predictions(boosting.predict(frame, model)) == pytest.approx(brute(x, y, 5, 3, 0.3, 3.0), abs=1e-9)


def test_training_sets_and_single_outputs(spark, small, tmp_path):
    """Heads of several training sets and of every candidate, on its observed rows, grow in the same jobs."""
    x, y = small
    y = y.copy()
    y[::5, 1] = np.nan
    frame = frame_of(spark, x, y).repartition(2)
    i = F.col("sample_id").cast("int")
    model = boosting.fit(frame, sets=[i % 3 != 0, i % 3 != 1], shared=False, max_iter=3, depth=2, step=0.5)
    got = predictions(boosting.predict(frame, model, which=F.lit(1)))
    train = np.arange(90) % 3 != 1
    for j in range(2):
        seen = train & ~np.isnan(y[:, j])
        borders = [np.unique(c)[:-1] for c in x.T]
        assert [b.tolist() for b in model.borders] == [b.tolist() for b in borders]
        assert got[seen, j] == pytest.approx(brute(x[seen], y[seen][:, [j]], 3, 2, 0.5, 3.0)[:, 0], abs=1e-9)
    boosting.save_router(spark, str(tmp_path / "router"), model, ["f2", "f0", "f1"], ["zeta", "Alpha"])
    loaded, names, models = boosting.load_router(spark, str(tmp_path / "router"))
    assert (names, models) == (["f2", "f0", "f1"], ["zeta", "Alpha"])
    assert predictions(boosting.predict(frame, loaded, which=F.lit(1))) == pytest.approx(got)
    assert sum(r.importance for r in boosting.importances(spark, model, names, models).collect()) == pytest.approx(2.0)


def test_folds_of_trees_are_single_fits(spark, small):
    x, y = small
    frame = frame_of(spark, x, y)
    cell = F.col("sample_id").cast("int") % 2
    got = predictions(experiments.held_out(frame, ["a", "b"], cell, 2, "gbt", max_iter=2, depth=2))
    for k in range(2):
        own = experiments.fit_predict(frame.where(cell != k), frame, ["a", "b"], "gbt", max_iter=2, depth=2)
        assert got[k::2] == pytest.approx(predictions(own)[k::2])


def test_forests_grow_the_same_on_one_task_and_by_levels(spark, tmp_path):
    """Both ways find a step and its additive partner; a candidate is fitted on the rows that observe it."""
    rng = np.random.default_rng(5)
    x = rng.random((600, 4))
    y = np.where(x[:, 0] > 0.5, 2.0, 0.0) + np.where(x[:, 1] > 0.3, 1.0, 0.0)
    rows = [(str(i), x[i].tolist(), [float(y[i]), None if i % 2 else float(-y[i])]) for i in range(600)] + [("none", [0.0] * 4, None)]
    frame = spark.createDataFrame(rows, "sample_id string, x array<double>, score array<double>").repartition(3, "sample_id")
    test = frame.where("score is not null")
    for local in (1000, 150):
        fitted = trees.fit_per_candidate(frame, ["a", "b"], "random_forest", trees=12, depth=8, local=local)
        assert [len(f.trees) for f in fitted] == [12, 12]
        for f in fitted:
            assert f.featureImportances.sum() == pytest.approx(1) and f.featureImportances[0] == f.featureImportances.max()
            # Of a node and its two children none is lost, whatever was grown where.
            assert all(sorted(np.concatenate([t.child[t.feature != forests.LEAF], t.child[t.feature != forests.LEAF] + 1])) == list(range(1, len(t.child))) for t in f.trees)
        got = {r.sample_id: r.pred for r in trees.predict(test, fitted).collect()}
        for c, sign in ((0, 1), (1, -1)):
            assert np.mean([abs(got[str(i)][c] - sign * y[i]) for i in range(600)]) < 0.3
    trees.save_router(spark, str(tmp_path / "forest"), fitted, list("wxyz"), ["a", "b"])
    loaded, names, models = trees.load_router(spark, str(tmp_path / "forest"))
    assert (names, models) == (list("wxyz"), ["a", "b"])
    assert {r.sample_id: r.pred for r in trees.predict(test, loaded).collect()} == got
    with pytest.raises(ValueError, match="fewer than two"):
        trees.fit_per_candidate(frame.where("sample_id in ('1', '3', '4')"), ["a", "b"], "random_forest", trees=2)


def test_forest_of_a_node_weighs_repeats_and_stops_at_the_leaf_size():
    b = np.array([[0], [0], [1], [2]], np.uint8)
    own, gains = forests.grown(b, np.array([0.0, 0.0, 3.0, 9.0]), np.array([1, 1, 2, 0]), 5, 2, 3, np.random.default_rng(1))
    assert own.feature.tolist() == [0, forests.LEAF, forests.LEAF] and own.border[0] == 0 and own.value.tolist() == [1.5, 0.0, 3.0]
    assert gains[0] == pytest.approx(9.0)
    alone, _ = forests.grown(b, np.array([0.0, 0.0, 3.0, 9.0]), np.array([1, 0, 2, 0]), 5, 2, 3, np.random.default_rng(1))
    assert alone.feature.tolist() == [forests.LEAF] and alone.value[0] == 2.0


def test_terms_of_a_sample_in_several_rows_are_counted_together(spark):
    """Counting makes one row per sample, nulls too; pairs do not cross texts."""
    rows = [("a", "Red red fox"), ("a", "fox den"), (None, "red den"), ("b", None), ("c", "x"), ("a", None)]
    lists = tfidf.term_lists(spark.createDataFrame(rows, "sample_id string, query string")).collect()
    got = {r.sample_id: dict(zip(r.terms, r.tfs)) for r in lists}
    assert len(lists) == 4 and got["b"] == got["c"] == {}
    assert got["a"] == {"red": 2, "fox": 2, "den": 1, "red red": 1, "red fox": 1, "fox den": 1}
    assert got[None] == {"red": 1, "den": 1, "red den": 1}
    weights = tfidf.tfidf_features(spark.createDataFrame(rows, "sample_id string, query string")).collect()
    assert {(r.sample_id, r.term) for r in weights} == {("a", "red"), ("a", "den"), (None, "red"), (None, "den")}
    one, two = 1 + np.log(2), 1.0
    assert {(r.sample_id, r.term): r.weight for r in weights}[("a", "red")] == pytest.approx(one / np.hypot(one, two))


def test_heads_fitted_whole_equal_those_of_a_job_per_level(spark, small):
    """Shared trees and trees per output, with training sets and unobserved outputs, come out the same both ways."""
    x, y = small
    y = y.copy()
    y[::7, 1] = np.nan
    frame = frame_of(spark, np.column_stack([x, np.ones(90)]), y).repartition(3)
    i = F.col("sample_id").cast("int")
    for shared in (True, False):
        kw = {"sets": [i % 3 != 0, i % 4 != 1], "shared": shared, "max_iter": 13, "depth": 4, "step": 0.3}
        one, two = boosting.fit(frame, **kw), boosting.fit(frame, local=0, **kw)
        for a, b in zip(one.heads, two.heads, strict=True):
            assert [(t.features, t.bins) for t in a.trees] == [(t.features, t.bins) for t in b.trees] and len(a.trees) == 13
            assert a.gains == pytest.approx(b.gains)
            for s, t in zip(a.trees, b.trees, strict=True):
                assert s.values == pytest.approx(t.values, abs=1e-12)


def test_small_tables_need_few_jobs_for_many_rounds(spark, small):
    frame = frame_of(spark, *small).repartition(3)
    spark.sparkContext.setJobGroup("few-jobs", "boosting")
    boosting.fit(frame, max_iter=100, depth=3)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 20


@pytest.mark.parametrize("name", ["fit_gbt_per_model", "fit_embedding_gbt", "perf_cost_eval_trees"])
def test_tree_queries_fit_all_rounds(spark, monkeypatch, name):
    """The queries leave the learner its own number of rounds."""
    asked = []

    def fit(train, **params):
        asked.append(params)
        raise InterruptedError

    monkeypatch.setattr(boosting, "fit", fit)
    frame = frame_of(spark, np.ones((6, 3)), np.ones((6, 2))).withColumn("cost", F.col("score"))
    for source in ("_cost_frame", "_vector_frame"):
        monkeypatch.setattr(learning, source, lambda *_: frame)
    monkeypatch.setattr(learning, "_mass_frame", lambda *_: (frame, list("abc")))
    monkeypatch.setattr(learning, "_gaps", lambda rows: rows)
    with pytest.raises(InterruptedError):
        QUERIES[name](spark, "")
    assert len(asked) == 1 and "max_iter" not in asked[0]


def test_networks_of_several_training_sets_equal_single_fits(spark):
    rng = np.random.default_rng(4)
    y = rng.random((200, 2))
    y[::9, 0] = np.nan
    frame = frame_of(spark, rng.random((200, 3)), y).repartition(3).persist()
    sets = [F.col("sample_id").cast("int") % 3 != 0, F.col("sample_id").cast("int") % 4 != 1]
    for own, cond in zip(network.fit_sets(frame, sets, max_iter=25, patience=4), sets, strict=True):
        alone = network.fit(frame.where(cond), max_iter=25, patience=4)
        assert own.steps == alone.steps and own.error == pytest.approx(alone.error)
        assert network.flat(own.layers) == pytest.approx(network.flat(alone.layers), abs=1e-9)
    with pytest.raises(ValueError):
        network.fit_sets(frame, [F.lit(False)])


def test_the_ablation_leaves_learners_their_own_settings(spark, monkeypatch):
    asked = {}

    def slots(rows, models, parts, learners):
        asked.update(learners)
        raise InterruptedError

    monkeypatch.setattr(experiments, "learner_slots", slots)
    monkeypatch.setattr(learning, "_mass_frame", lambda *_: (frame_of(spark, np.ones((6, 3)), np.ones((6, 2))), list("abc")))
    with pytest.raises(InterruptedError):
        QUERIES["learner_ablation"](spark, "")
    assert asked == {"ols": {}, "ridge": {}, "gbt": {}, "random_forest": {}, "mlp": {}}
