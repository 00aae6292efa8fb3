"""Runs side by side, selection by rank, subtractive cutoffs and draws down a tree, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointsman.functions import draws
from pointsman.operators import metrics, paired, ranking, selective, splits
from pointsman.operators.metrics import Runs
from pointsman.plans import experiments

MODELS = ["a", "b", "c"]
KEYS = ("seed", "system")


@pytest.fixture(scope="module")
def slots(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        hot = "hot" if i % 3 else f"d{i % 7}"
        one, two = rng.random() < 0.7, rng.random() < 0.6
        picks = [rng.randint(1, 3) if one else None, rng.randint(1, 3) if one else None, rng.randint(1, 3) if two else None]
        rows.append((str(i), hot, [rng.random() for _ in MODELS], picks))
    return spark.createDataFrame(rows, "sample_id string, dataset string, score array<double>, slots array<int>").persist()


RUNS = Runs([(1, "x"), (1, "y"), (2, "x")], KEYS)


def test_metrics_of_slots_are_those_of_rows(slots):
    long = metrics.slot_picks(slots, MODELS, RUNS)
    want = {(r.seed, r.system): r for r in metrics.benchmark_metrics(slots, long, MODELS, KEYS).collect()}
    got = metrics.slot_metrics(slots, MODELS, RUNS).collect()
    assert len(got) == 3
    for r in got:
        w = want[r.seed, r.system]
        for c in (*metrics.METRICS, "n_datasets", "n_test"):
            assert r[c] == pytest.approx(w[c])
        assert r.best_single_model == w.best_single_model
    accuracy = {(r.seed, r.system): r.AvgAcc for r in metrics.macro_accuracy(long, keys=KEYS).collect()}
    assert {(r.seed, r.system): pytest.approx(r.AvgAcc) for r in metrics.slot_accuracy(slots, RUNS).collect()} == accuracy


def test_slots_need_no_exchange_by_sample(slots):
    plan = metrics.slot_metrics(slots, MODELS, RUNS)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" not in plan and "Join" not in plan


def test_supports(slots):
    long = metrics.slot_picks(slots, MODELS, RUNS)
    want = {(r.seed, r.system): (r.n_ids, r.digest_0, r.digest_1) for r in metrics.support_digest(long, KEYS).collect()}
    got = metrics.slot_supports(slots, RUNS).collect()
    assert {(r.seed, r.system): (r.n_ids, r.digest_0, r.digest_1) for r in got} == want and all(r.n_mismatches == 0 for r in got)


def test_unequal_supports_and_open_rows_fail(slots):
    odd = slots.withColumn("slots", F.when(F.col("sample_id") == "7", F.array(F.lit(1), F.lit(None).cast("int"), F.lit(2))).otherwise(F.col("slots")))
    assert metrics.slot_mismatches(odd, RUNS) == [(1, "7")]
    with pytest.raises(ValueError, match="do not.*'7'"):
        experiments.main_table(odd, MODELS, RUNS, "x")
    with pytest.raises(Exception, match=metrics.UNEQUAL):
        metrics.slot_metrics(odd, MODELS, RUNS).collect()
    hole = slots.withColumn("score", F.when(F.col("slots")[0].isNotNull(), F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.5))).otherwise(F.col("score")))
    with pytest.raises(Exception, match=metrics.INCOMPLETE):
        metrics.slot_metrics(hole, MODELS, RUNS).collect()


@pytest.mark.parametrize("limit", [200_000, 30])
def test_first_sums(spark, monkeypatch, limit):
    """With a small limit, buckets are cut again, the hot value by further digits of the tie."""
    monkeypatch.setattr(ranking, "SORT_ROWS", limit)
    monkeypatch.setattr(ranking, "VALUE_BUCKETS", 4)
    monkeypatch.setattr(ranking, "HASH_DIGITS", 1)
    rng = random.Random(2)
    rows = [(str(i), "hot" if i % 4 else "s", 0.5 if i % 3 == 0 else round(rng.random(), 2), float(rng.randint(0, 9)), 1.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "sample_id string, g string, u double, a double, b double").withColumn("tie", draws.hash_text(F.col("sample_id")))
    ranks = lambda n: F.array(F.lit(0), F.lit(1), F.floor(n / 3), F.floor(n / 2), n - 1, n)
    tie = {r.sample_id: r.tie for r in df.collect()}
    for keys in ([], ["g"]):
        got = ranking.first_sums(df, keys, "u", "tie", ["a", "b"], ranks).collect()
        seen = 0
        for g in ["hot", "s"] if keys else [None]:
            own = sorted((r for r in rows if g is None or r[1] == g), key=lambda r: (r[2], tie[r[0]]))
            n = len(own)
            for k in {0, 1, n // 3, n // 2, n - 1, n}:
                (r,) = [r for r in got if r["rank"] == k and (g is None or r.g == g)]
                assert (r.n, r.sum_a, r.sum_b) == (n, sum(x[3] for x in own[:k]), float(k))
                seen += 1
        assert seen == len(got)
    assert ranking.first_sums(df.limit(0), [], "u", "tie", ["a"], ranks).count() == 0


def test_no_window_over_all_rows(spark):
    """Only rows of buckets that hold a cut are ranked."""
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("sample_id"), F.rand(3).alias("u"), F.lit(1.0).alias("regret"))
    got = {round(r.coverage, 4): (r.risk, r.n) for r in selective.risk_coverage_curve(rows, "u").collect()}
    assert got == {c: (1.0, round(20_000 * c)) for c in selective.RISK_COVERAGES}


@pytest.mark.parametrize("grouped", [False, True])
def test_holdout_labels_are_those_of_single_splits(spark, grouped):
    rng = random.Random(3)
    rows = [(str(i), "hot" if i % 3 else f"d{i % 5}", ["News", "law", "x", None][rng.randint(0, 3)], f"q{rng.randint(0, 60)}") for i in range(400)]
    rows += [("one", "single", "law", "alone")]
    df = spark.createDataFrame(rows, "sample_id string, dataset string, domain string, query string")
    names = ["news", "LAW", "x"]
    got = {r.sample_id: r.labels for r in splits.holdout_labels(df, names, 0.2, 5, grouped=grouped).collect()}
    assert len(got) == len(rows)
    for k, name in enumerate(names):
        rest = df.where((F.lower("domain") != name.lower()) | F.col("domain").isNull())
        want = {r.sample_id: "fit" if r.partition == "train" else "calibration" for r in splits.id_split(rest, 0.8, 5, grouped).collect()}
        for i, _, domain, _ in rows:
            assert got[i][k] == ("test" if (domain or "").lower() == name.lower() else want[i])


def test_draws_down_a_tree(spark, monkeypatch):
    """Chunks split a replicate's draws among them: sizes add up, moments are those of the bootstrap."""
    rng = np.random.default_rng(4)
    rows = [(f"d{i % 2}", str(i), float(rng.normal()), 1) for i in range(400)]
    u = spark.createDataFrame(rows, "dataset string, unit string, total double, size long")
    values = {d: np.array([r[2] for r in rows if r[0] == d]) for d in ("d0", "d1")}
    theory = np.sqrt(sum(v.var() / len(v) for v in values.values())) / 2
    for per_chunk in (10_000, 30):
        monkeypatch.setattr(paired, "VALUES_PER_CHUNK", per_chunk)
        parts = paired._count_bootstrap(u, 2000, 7).collect()
        assert len(parts) == 4000 and {r.size for r in parts} == {200.0}
        macro = [r.macro for r in paired.bootstrap_replicates(u, 2000, 7, "counts").collect()]
        assert np.mean(macro) == pytest.approx(np.mean([v.mean() for v in values.values()]), abs=theory / 8)
        assert np.std(macro) == pytest.approx(theory, rel=0.1)


def test_counter_draws_are_even(spark):
    rows = spark.range(200_000).select((draws.mixed(F.lit(12345).cast("long"), F.col("id")) % 97).alias("s")).groupBy("s").count().collect()
    counts = np.array([r["count"] for r in rows])
    chi = ((counts - 200_000 / 97) ** 2 / (200_000 / 97)).sum()
    assert len(rows) == 97 and 50 < chi < 160
    keys = spark.range(2000).select(draws.mixed(draws.hash_int("k", F.col("id")), F.lit(5).cast("long")).alias("s"))
    assert keys.distinct().count() == 2000


def test_scratch_folder_without_a_setting(spark):
    from pointsman.session import scratch_path

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        assert scratch_path(spark, "a").rsplit("/", 2)[0] == scratch_path(spark, "b").rsplit("/", 2)[0]

