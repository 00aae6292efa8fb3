"""Draws, sums and fits in chunks give the rows of the plain rule, and no step grows with draws or tasks."""

import hashlib
import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark import RDD

from pointsman.catalog import pools, quality
from pointsman.operators import blocks, boosting, paired, selective


def _mixed(key, i):
    mask = (1 << 31) - 1
    x = (i * 2654435761 + key) & mask
    x = ((x ^ (x >> 15)) * 739982445) & mask
    x = ((x ^ (x >> 12)) * 695872825) & mask
    return x ^ (x >> 15)


def _md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("slots", [7, 1 << 20])
def test_hash_bootstrap_is_the_plain_rule_and_joins_no_draws(spark, monkeypatch, slots):
    monkeypatch.setattr(paired, "SLOTS", slots)
    rng = random.Random(3)
    units = [("a" if i % 4 else f"b{i % 3}", f"u{i}", rng.choice([-1.0, 0.0, 0.25]), 1 + i % 3) for i in range(60)]
    u = spark.createDataFrame(units, "dataset string, unit string, total double, size long")
    sums = paired._hash_bootstrap(u, 40, 9)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0," not in plan.replace("cast(0 as bigint)", "0")
    got = {(r.dataset, r.replicate): (r.total, r["size"]) for r in sums.collect()}
    want = {}
    for d in {x[0] for x in units}:
        own = sorted((x for x in units if x[0] == d), key=lambda x: _md5(x[1]))
        for b in range(40):
            key = int(_md5(9, b, d)[:8], 16)
            picked = [own[_mixed(key, i) % len(own)] for i in range(len(own))]
            want[d, b] = (pytest.approx(sum(x[2] for x in picked)), sum(x[3] for x in picked))
    assert got == want


def test_random_abstention_is_the_plain_rule(spark, monkeypatch):
    monkeypatch.setattr(selective, "DRAW_DIGITS", 1)
    rng = random.Random(4)
    rows = [(f"s{i}", "big" if i % 5 else f"d{i % 3}", rng.random() if i % 11 else None, rng.random()) for i in range(150)]
    rows += [("s1", "big", 0.5, 0.25), ("none", None, 0.1, 0.2)]
    base = spark.createDataFrame(rows, "sample_id string, domain string, router_score double, fallback_score double")
    coverages = [0.0, 0.3, 0.5, 1.0]
    got = {(r.domain, r.coverage): (r.score, r["std"]) for r in selective._random_draws(base, coverages, 30, 7).collect()}
    want = {}
    for d in {x[1] for x in rows if x[1]}:
        own = [x for x in rows if x[1] == d]
        for c in coverages:
            each = []
            for t in range(30):
                hashes = {x[0]: _md5(7, t, x[0]) for x in own}
                cut = ["", *sorted(hashes[x[0]] for x in own)][round(len(own) * c)]
                seen = [v for x in own if (v := x[2] if hashes[x[0]] <= cut else x[3]) is not None]
                each.append(sum(seen) / len(seen))
            want[d, c] = (pytest.approx(np.mean(each)), pytest.approx(np.std(each, ddof=1), abs=1e-9))
    assert got == want


def test_block_sums_reach_the_driver_as_one_array(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN_IN", 3)
    sent = []
    collect = RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    arrays = spark.sparkContext.parallelize(range(20), 20).map(lambda i: np.array([i, 1.0]))
    assert blocks.merged(arrays, 2, 20).tolist() == [190.0, 20.0]
    assert [len(s) for s in sent] == [1]
    assert blocks.merged(spark.sparkContext.parallelize([], 4), 2, 4).tolist() == [0.0, 0.0]


def test_a_level_sums_only_the_smaller_side(spark, monkeypatch):
    sizes = []
    total = blocks.Blocks.total
    monkeypatch.setattr(blocks.Blocks, "total", lambda self, add, size: sizes.append(size) or total(self, add, size))
    rows = [([float(i % 4), float(i % 3)], [float(i % 5)]) for i in range(90)]
    model = boosting.fit(spark.createDataFrame(rows, "x array<double>, score array<double>"), max_iter=1, depth=3)
    width = sum(len(b) + 1 for b in model.borders)
    assert sizes[1:] == [width * 2, width * 2, 2 * width * 2]


def test_samples_of_the_lambda_grid_are_counted_in_place(spark, tmp_path):
    lines = [(i % 9, i % 7 + 1, i, i, datetime(2020, 1, 1 + i % 5), 0.01 * (i % 11), 10.0 + i) for i in range(120)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_shipdate timestamp, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, "p", "o") for i in range(8)], "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    out = quality.lambda_grid_cross(spark, str(tmp_path))
    n = len({(x[0], x[1]) for x in lines if x[0] < 8})
    assert {(r["lambda"], r.n_rows, r.n_samples) for r in out.collect()} == {(i / 20, n, 8) for i in range(21)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 0
    frame = pools.o_frame(spark, str(tmp_path))
    assert sorted(map(tuple, pools.o_observed(frame).collect())) == sorted(map(tuple, pools.o_outcomes(spark, str(tmp_path)).select("sample_id", "dataset", "domain", "model", "score", "cost").collect()))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" in plan and "model" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_random_abstention_draws_where_rows_are(spark, monkeypatch):
    """No plan lists a row once per repeat, and the wanted rows are the same if a task may not know all cells."""
    rng = random.Random(6)
    rows = [(f"s{i % 190}", "big" if i % 4 else f"d{i % 5}", rng.random(), rng.random() if i % 7 else None) for i in range(200)]
    base = spark.createDataFrame([*rows, (None, "big", 0.5, 0.5)], "sample_id string, domain string, router_score double, fallback_score double")
    plans, plain = [], selective.written
    monkeypatch.setattr(selective, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, name))
    one = {(r.domain, r.coverage): r for r in selective._random_draws(base, [0.25, 0.5, 0.8], 20, 3).collect()}
    assert plans and "sequence(" not in plans[0] and "md5(" not in plans[0]
    monkeypatch.setattr(selective, "CUT_CELLS", 3)
    two = {(r.domain, r.coverage): r for r in selective._random_draws(base, [0.25, 0.5, 0.8], 20, 3).collect()}
    assert one.keys() == two.keys() and len(one) == 3 * len({r[1] for r in rows})
    for k, r in one.items():
        assert (r.score, r["std"]) == (pytest.approx(two[k].score), pytest.approx(two[k]["std"]))


def test_signs_are_drawn_where_units_are(spark):
    """Signs are the bits of the hash of (seed, block, unit), and no plan lists a unit once per block."""
    rng = random.Random(8)
    rows = [(f"u{i}" if i < 110 else "long" * 20 + str(i), rng.choice([-0.5, 0.25, 1.0])) for i in range(120)] + [(None, 0.125), ("none", None), ("u3", 0.75)]
    stats = paired.permutation_stats(spark.createDataFrame(rows, "unit string, contribution double").repartition(3), 70, 9)
    assert "sequence(" not in (plan := stats._jdf.queryExecution().optimizedPlan().toString()) and "md5(" not in plan
    got = {r.permutation: r.stat for r in stats.collect()}
    want = {}
    for p in range(70):
        words = [int(_md5(9, p // 32, *([] if u is None else [u]))[:8], 16) for u, _ in rows]
        want[p] = pytest.approx(sum((c or 0.0) * (1 if w >> (p % 32) & 1 else -1) for w, (_, c) in zip(words, rows)))
    assert got == want


def test_a_batch_of_many_domains_is_added_up_in_parts():
    """Sums of a batch take the place of a few domains' sums at a time, and are those of each row alone."""
    rows = [(0, 6, f"d{i:03d}", f"s{i}", float(i), None if i % 3 else 1.0) for i in range(200)] + [(7, 9, "d000", None, 2.0, 3.0)]
    columns = dict(zip(("a", "b", "domain", "sample_id", "_r", "_f"), zip(*rows)))
    got = {}
    for batch in selective._drawn_sums(iter([pa.RecordBatch.from_pydict(columns)]), 5, 2):
        for row in batch.to_pylist():
            got[row["domain"], row["repeat"]] = row
    assert len(got) == 200 * 7 + 3 and selective.RUNS_AT_ONCE < 200
    for a, b, domain, sample, r, f in rows:
        for repeat in range(a, b + 1):
            bucket = int(_md5(5, repeat, *([] if sample is None else [sample]))[:2], 16)
            want = {"domain": domain, "repeat": repeat, "_bucket": bucket, "_size": 1, "_s_r": r, "_s_f": f or 0.0, "_c_r": 1, "_c_f": int(f is not None)}
            assert got[domain, repeat] == want
