"""Result files written by hand: headers, path fallback, demo files, damaged files, latest file."""

import json

import pytest

from pointsman.operators import audits, enrich
from pointsman.plans import ingest
from pointsman.sources import results, tables


@pytest.fixture()
def root(tmp_path):
    def put(rel, payload):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")

    def payload(model, score, **extra):
        recs = [
            {"index": 1, "origin_query": "one", "prompt": "P one", "score": score, "cost": None, "prompt_tokens": 3},
            {"origin_query": " ", "prompt": "two", "score": True, "cost": 0.5},
            {"origin_query": "", "prompt": None, "score": 1},
        ]
        return {"dataset_name": "Set-A", "split": "test", "model_name": model, "records": recs, **extra}

    put("x/test/m1/r_20250101_000000.json", payload("m1", 0.1))
    put("x/test/m1/r_20250201_000000.json", payload("m1", 0.2))
    put("x/test/m2/r.json", payload("m2", 0.4))
    put("x/test/m3/r.json", payload("m3", 0.9, demo=True))
    put("Set-B/test/m1/r.json", {"records": [{"origin_query": "three", "score": "0.7"}]})
    put("x/test/m4/r.json", "{ not json")
    put("short.json", {"records": []})
    return str(tmp_path)


def test_scan_filter_latest(spark, root):
    files = results.scan_result_files(spark, root)
    assert sorted((r.dataset, r.model, r.demo) for r in files.collect()) == [
        ("Set-A", "m1", False), ("Set-A", "m1", False), ("Set-A", "m2", False), ("Set-A", "m3", True), ("Set-B", "m1", False),
    ]
    rows = results.load_records(spark, root).collect()
    assert {(r.dataset, r.model, r["index"], r.score) for r in rows} == {
        ("Set-A", "m1", "1", 0.2), ("Set-A", "m1", "1", 1.0), ("Set-A", "m1", "2", 1.0), ("Set-A", "m2", "1", 0.4),
        ("Set-A", "m2", "1", 1.0), ("Set-A", "m2", "2", 1.0), ("Set-B", "m1", "0", 0.7),
    }
    wanted = results.load_records(spark, root, datasets={"set a"}, models={"m2"})
    assert {r.model for r in wanted.collect()} == {"m2"}


def test_ingest_from_files(spark, root):
    pool = ingest.ingest_generic(results.load_records(spark, root, datasets={"set_a"}))
    queries = {r.query for r in pool.samples.collect()}
    assert queries == {"one", "two"} and pool.outcomes.count() == 4
    partial, audit = ingest.ingest_partial(
        results.load_records(spark, root), spark.createDataFrame([("set_a", 2), ("set_b", 5)], "dataset string, expected long")
    )
    assert partial.samples.count() == 3
    assert {(r.dataset, r.delta) for r in audit.collect()} == {("set_a", 0), ("set_b", -4)}


def test_rectangular_ingest_rejects_another_query(spark):
    """Also when the clashing sample itself would be dropped as incomplete, as here; another one stays."""
    cells = [("m1", "1", "a"), ("m2", "1", "b"), ("m1", "2", "c"), ("m2", "2", "c")]
    rows = [("d", "s", m, 0, i, q, None, 1.0, 0.0, 0, 0) for m, i, q in cells]
    schema = "dataset string, split string, model string, pos long, index string, origin_query string, prompt string, score double, cost double, prompt_tokens long, completion_tokens long"
    with pytest.raises(Exception, match="query differs"):
        ingest.ingest_rectangular(spark.createDataFrame(rows, schema)).samples.collect()


def test_index_alignment_reports_each_problem(spark):
    rows = [("m1", "1"), ("m1", "2"), ("m2", "1"), ("m2", "1"), ("m2", "9")]
    got = audits.index_alignment(spark.createDataFrame(rows, "model string, index string"), ["m1", "m2", "m3"])
    assert sorted((r.problem, r.model, r["index"]) for r in got.collect() if r["index"]) == [
        ("duplicate", "m2", "1"), ("extra", "m2", "9"), ("missing", "m2", "2"),
    ]
    assert got.where("problem = 'missing_model' and model = 'm3'").count() == 1


def test_last_decision_wins(spark, tmp_path):
    line = '{{"sample_id": "a", "answers": {{"p": {{"type": "noul", "noul": {}}}}}}}\n'
    (tmp_path / "d.jsonl").write_text(line.format(0.1) + "\n" + line.format(0.9))
    rows = tables.last_decisions(tables.scan_decisions(spark, str(tmp_path))).collect()
    assert [r.answers["p"].noul for r in rows] == [0.9]


def test_last_decision_wins_over_blocks_of_a_file(spark, tmp_path):
    line = '{{"sample_id": "a", "answers": {{"p": {{"type": "noul", "noul": {}}}}}}}\n'
    (tmp_path / "d.jsonl").write_text("".join(line.format(i / 1000) for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        scanned = tables.scan_decisions(spark, str(tmp_path))
        assert scanned.select("_block").distinct().count() > 1
        rows = tables.last_decisions(scanned).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.answers["p"].noul for r in rows] == [0.399]


def test_unique_predictions_stay_as_they_are(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, None), (2, "a", None, "m"), (1, None, 3.0, "n")], "seed int, sample_id string, v double, w string")
    got = tables.unique_predictions(rows, ("seed",))
    assert got.columns == rows.columns and sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


def test_duplicate_prediction_fails(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "sample_id string, selected_score double")
    with pytest.raises(Exception, match="duplicate prediction"):
        tables.unique_predictions(rows).collect()


def test_enrichment_resumes_and_keeps_errors(spark, tmp_path):
    samples = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "y")], "sample_id string, query string")
    done = spark.createDataFrame([("c",)], "sample_id string")

    def judge(q):
        if q == "bad":
            raise RuntimeError("no")
        return '{"ok": 1}'

    path = str(tmp_path / "out")
    row = enrich.enrich(samples, done, judge, path).first()
    assert (row.requested, row.completed, row.failed) == (2, 1, 1)
    saved = {r.sample_id: (r.answers, r.error) for r in spark.read.parquet(path).collect()}
    assert saved == {"a": ('{"ok": 1}', None), "b": (None, "RuntimeError: no")}
    ok = spark.read.parquet(path).where("status = 'ok'")
    assert [r.sample_id for r in enrich.pending(samples, done.unionByName(ok.select("sample_id"))).collect()] == ["b"]
