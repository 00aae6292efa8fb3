"""Splits and folds: group integrity, counts, and agreement with plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pointsman.functions import draws
from pointsman.operators import ranking, splits


def frame(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, dataset string, query string, domain string")


def skewed(spark, n=3000):
    """One dataset and one text hold most of the rows."""
    return frame(spark, [(str(i), "big" if i % 10 else "small", "same" if i % 3 == 0 else f"q {i}", "d") for i in range(n)])


@pytest.mark.parametrize("seed", [1, 2, 3407])
def test_copies_stay_on_one_side(spark, seed):
    rows = [(str(i), "d", "same" if i < 2 else f"q{i}", "x") for i in range(10)]
    got = {r.sample_id: r.partition for r in splits.id_split(frame(spark, rows), 0.7, seed, grouped=True).collect()}
    assert got["0"] == got["1"]
    groups = {k: v for k, v in got.items() if k != "1"}
    assert sum(v == "train" for v in groups.values()) == 6  # 9 groups, half-even of 6.3


def test_split_counts_per_dataset(spark):
    rows = [(f"{d}{i}", d, f"{i}", "x") for d, n in (("a", 1), ("b", 2), ("c", 5), ("e", 1000)) for i in range(n)]
    got = splits.id_split(frame(spark, rows), 0.5, 9).groupBy("dataset").agg(F.sum((F.col("partition") == "train").cast("int")).alias("n"))
    assert {r.dataset: r.n for r in got.collect()} == {"a": 1, "b": 1, "c": 2, "e": 500}


def test_all_rows_are_copies(spark):
    rows = [(str(i), "d", " one  text ", "x") for i in range(50)]
    assert splits.id_split(frame(spark, rows), 0.5, 9, grouped=True).where("partition = 'test'").count() == 0


def test_folds_differ_by_at_most_one_and_keep_groups(spark):
    got = splits.stratified_folds(skewed(spark), 4, 5, grouped=True)
    sizes = got.select("dataset", "query", "fold").distinct().groupBy("dataset", "fold").count().collect()
    for d in ("big", "small"):
        counts = [r["count"] for r in sizes if r.dataset == d]
        assert len(counts) == 4 and max(counts) - min(counts) <= 1
    assert got.groupBy("dataset", "query").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_nested_split_is_a_partition_of_the_rows(spark):
    got = splits.nested_split(skewed(spark))
    assert got.count() == got.select("sample_id").distinct().count() == 3000
    assert {r[0] for r in got.select("partition").distinct().collect()} == {"inner_fit", "validation", "test"}


def test_holdout_labels_match_single_splits(spark):
    rows = frame(spark, [(str(i), f"s{i % 3}", f"q{i}", f"d{i % 4}") for i in range(400)])
    domains = ["d0", "d1", "d2", "d3"]
    got = splits.holdout_labels(rows, domains, 0.2, 7)
    for i, d in enumerate(domains):
        want = splits.calibration_split(rows, d, 0.2, 7).select("sample_id", "partition")
        odd = got.select("sample_id", F.col("labels")[i].alias("label")).join(want, "sample_id").where("label <> partition")
        assert odd.count() == 0


@pytest.mark.parametrize("grouped", [False, True])
def test_many_seeds_equal_single_splits(spark, grouped):
    got, names = splits.id_splits(skewed(spark), [1, 42, 3407], 0.7, grouped)
    for seed, column in names.items():
        want = splits.id_split(skewed(spark), 0.7, seed, grouped).select("sample_id", "partition")
        both = got.join(want, "sample_id")
        assert both.count() == 3000 and both.where(F.col(column) != F.col("partition")).count() == 0


@pytest.mark.parametrize("grouped", [False, True])
def test_nested_folds_equal_folds_of_each_training_set(spark, grouped):
    rows = splits.stratified_folds(skewed(spark), 3, 5, grouped, "outer").persist()
    seeds = [11, 12, 13]
    got = splits.nested_folds(rows, "outer", 3, 2, seeds, grouped)
    assert got.count() == 3000
    for o, seed in enumerate(seeds):
        want = splits.stratified_folds(rows.where(F.col("outer") != o), 2, seed, grouped).select("sample_id", "fold")
        both = got.join(want, "sample_id", "left")
        assert both.where(~F.col("inner")[o].eqNullSafe(F.coalesce("fold", F.lit(-1)))).count() == 0


def test_unknown_holdout(spark):
    with pytest.raises(ValueError):
        splits.holdout_split(skewed(spark, 10), "dataset", "none")


def test_positions_equal_plain_windows_under_skew(spark):
    rows = skewed(spark).withColumn("h", draws.hash_text(1, F.col("sample_id")))
    by_hash = ranking.hash_positions(rows, ["dataset"], "h")
    want = F.row_number().over(Window.partitionBy("dataset").orderBy("h"))
    assert by_hash.withColumn("w", want).where("w <> pos").count() == 0
    # A third of the rows share one value; the rest are distinct.
    valued = rows.withColumn("v", F.when(F.col("query") == "same", 100.0).otherwise(F.col("sample_id").cast("double")))
    for keys in ([], ["dataset"]):
        placed = ranking.value_positions(valued, keys, "v", "h")
        over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        assert placed.withColumn("w", F.row_number().over(over.orderBy("v", "h"))).where("w <> pos").count() == 0


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=2500), np.full(1200, 0.25)])
    rows = spark.createDataFrame([(float(v), int(i % 3 == 0)) for i, v in enumerate(values)], "v double, k int")
    shares = [0.0, 0.1, 0.5, 0.61803, 0.95, 1.0]
    got = {r.share: r.value for r in ranking.exact_quantiles(rows, "v", shares).collect()}
    assert [got[s] for s in shares] == pytest.approx(list(np.quantile(values, shares)))
    keyed = {(r.k, r.share): r.value for r in ranking.exact_quantiles(rows, "v", [0.3], ["k"]).collect()}
    for k in (0, 1):
        own = values[[int(i % 3 == 0) == k for i in range(len(values))]]
        assert keyed[(k, 0.3)] == pytest.approx(np.quantile(own, 0.3))
