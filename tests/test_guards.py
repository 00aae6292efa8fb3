"""Inputs that must fail, and calls that must mean the same at any size."""

import pytest
from pyspark.sql import functions as F

from pointsman.operators import cost, matrix, metrics, paired, routing, selective


def test_two_outcomes_of_a_candidate_fail(spark):
    rows = spark.createDataFrame([("a", "m", 0.1), ("a", "m", 0.9)], "sample_id string, model string, score double")
    with pytest.raises(Exception, match="two outcomes"):
        matrix.outcome_arrays(rows, ["m"]).collect()


def test_sample_without_candidate_fails(spark):
    frame = spark.createDataFrame(
        [("a", "d", [0.6], [0.5], [0.1], [0.1]), ("b", "d", [None], [None], [0.1], [0.1])],
        "sample_id string, dataset string, score array<double>, cost array<double>, pred array<double>, pred_cost array<double>",
    )
    with pytest.raises(Exception, match="no candidate"):
        cost.sweep_picks(frame, ["m"], {"pred": (0.0, 1.0), "pred_cost": (0.0, 1.0)}).collect()
    with pytest.raises(Exception, match="no candidate"):
        routing.selected_with_cost(frame, ["m"]).collect()


def test_too_many_values_fail_instead_of_being_cut(spark):
    rows = spark.range(matrix.MAX_CANDIDATES + 1).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError, match="more than"):
        matrix.few_values(rows, "v")


def test_all_mismatches_are_counted(spark):
    rows = [(1, "x", str(i)) for i in range(30)] + [(1, "y", str(i)) for i in range(5)]
    p = spark.createDataFrame(rows, "seed int, system string, sample_id string")
    assert metrics.partly_covered(p, ("seed",)).count() == 25
    assert metrics.support_mismatches(p, ("seed",)).count() == 10


def test_unknown_ways_are_refused(spark):
    with pytest.raises(ValueError):
        paired.bootstrap_replicates(None, 10, draw="auto")
    empty = spark.createDataFrame([], "domain string, sample_id string, uncertainty double, router_score double, fallback_score double")
    with pytest.raises(ValueError):
        selective.abstention_controls(empty, random="auto")


def test_two_predictions_of_a_sample_fail(spark):
    frame = spark.createDataFrame([("a", "d", [0.1, 0.2]), ("b", "d", [0.3, 0.1])], "sample_id string, dataset string, score array<double>")
    once = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.3), (2, "a", 0.2)], "seed int, sample_id string, selected_score double")
    assert {r.seed: r.n_test for r in metrics.benchmark_metrics(frame, once, ["m", "n"], ("seed",)).collect()} == {1: 2, 2: 1}
    with pytest.raises(Exception, match="two predictions"):
        metrics.benchmark_metrics(frame, once.union(once.limit(1)), ["m", "n"], ("seed",)).collect()


def test_group_without_threshold_fails(spark):
    kind = "domain string, uncertainty double, router_score double, fallback_score double"
    good = [("x", i / 10, i / 10, 0.4) for i in range(10)]
    got = selective.select_threshold(spark.createDataFrame(good, kind), keys=("domain",)).collect()
    assert len(got) == 1 and got[0].coverage >= 0.5
    bad = spark.createDataFrame([*good, ("y", float("nan"), 0.1, 0.2), ("y", float("nan"), 0.3, 0.2)], kind)
    with pytest.raises(Exception, match="no threshold"):
        selective.select_threshold(bad, keys=("domain",)).collect()
