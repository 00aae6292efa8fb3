"""Result files read in two phases, enrichment that dies and runs again, windows with late rows and a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pointsman.operators import enrich, paired
from pointsman.operators.metrics import Runs
from pointsman.sources import results, tables
from pointsman.streaming import monitor
from pointsman.streaming import route as live
from tests.test_sources import root  # noqa: F401


def test_only_latest_files_are_read_for_records(spark, root):  # noqa: F811
    rows = results.load_records(spark, root)
    read = sorted(p.split("/")[-4:] for p in rows.inputFiles())
    assert [p[-3:] for p in read] == [["test", "m1", "r.json"], ["test", "m1", "r_20250201_000000.json"], ["test", "m2", "r.json"]]
    assert "records" not in results.scan_result_files(spark, root, records=False).columns
    assert results.load_records(spark, root, datasets={"none"}).count() == 0


def test_paths_with_odd_names(spark, tmp_path):
    at = tmp_path / "Set A+1%20[x]" / "test" / "m1"
    at.mkdir(parents=True)
    (at / "r.json").write_text('{"records": [{"prompt": "p", "score": 1}]}')
    assert [r.score for r in results.load_records(spark, str(tmp_path)).collect()] == [1.0]


def _calls(path):
    return sorted(path.read_text().split()) if path.exists() else []


def test_a_job_that_died_runs_again(spark, tmp_path):
    """The judge is asked once for every sample of a committed slice; nothing is doubled."""
    seen, at = tmp_path / "calls", str(tmp_path / "out")
    samples = spark.createDataFrame([(f"s{i}", f"text {i}") for i in range(20)], "sample_id string, query string").repartition(1)
    done = spark.createDataFrame([("s0",)], "sample_id string")
    flag = tmp_path / "die"

    def judge(q):
        if flag.exists() and q == "text 13":
            raise SystemExit("the machine died")  # no error of the row: the task fails
        with open(seen, "a") as f:
            f.write(q.split()[1] + "\n")
        if q == "text 5":
            raise ValueError("too odd")
        return q.upper()

    flag.write_text("x")
    with pytest.raises(Exception):
        enrich.enrich(samples, done, judge, at, run="a", meta={"backend": "test"})
    flag.unlink()
    before = enrich.results(spark, at).count()
    calls = len(_calls(seen))
    counts = enrich.enrich(samples, done, judge, at, run="a", meta={"backend": "test"}).first()
    assert tuple(counts) == (19, 18, 1)
    rows = enrich.results(spark, at).collect()
    assert sorted(r.sample_id for r in rows) == sorted(f"s{i}" for i in range(1, 20)) and len(rows) == 19
    assert [r.error for r in rows if r.status == "error"] == ["ValueError: too odd"]
    # Only slices that were not committed were judged in the second run.
    assert len(_calls(seen)) - calls == 19 - before
    again = len(_calls(seen))
    assert tuple(enrich.enrich(samples, done, judge, at, run="a").first()) == (19, 18, 1) and len(_calls(seen)) == again
    # Another run takes what has no answer: the error is tried again.
    assert tuple(enrich.enrich(samples, done, judge, at, run="b").first()) == (1, 0, 1)
    log = spark.read.parquet(f"{at}/log").where("run = 'a' and slice >= 0").collect()
    assert all(r["meta"] == {"backend": "test"} for r in log) and sum(r.requested for r in log) == 19


def test_windows_late_rows_and_a_restart(spark, tmp_path):
    schema = "ts timestamp, kind string, value double"
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        windows = monitor.outcome_monitor(live.scan_stream(spark, source, spark.createDataFrame([], schema).schema), "ts", "kind", "value")
        live.sink(windows, out, log, available_now=True).awaitTermination()
        got = spark.read.parquet(out).collect()
        return sorted((r.start.day, r.candidate, r.n, r.mean_score) for r in got)

    first = arrive([(day(1), "a", 1.0), (day(1, 5), "a", 3.0), (day(1), "b", None), (day(2), "a", 5.0), (None, "a", 9.0), (day(3, 1), "a", 7.0)])
    assert first == [(1, "a", 2, 2.0), (1, "b", 1, None)]
    # Day 1 is closed, so its late row is dropped; that of day 2 is in time.
    second = arrive([(day(1, 7), "a", 100.0), (day(2, 9), "a", 7.0), (day(5), "b", 1.0)])
    assert second == [*first, (2, "a", 2, 6.0), (3, "a", 1, 7.0)]
    base = spark.createDataFrame([("a", 6.5)], "candidate string, base double")
    assert [(r.start.day, r.fall) for r in monitor.drifted(spark.read.parquet(out), base, 0.4).orderBy("start").collect()] == [(1, 4.5), (2, 0.5)]


def test_test_of_two_slots_is_that_of_two_tables(spark):
    rows = [(str(i), f"d{i % 3}", f"q{i % 50}", [0.1 * (i % 7), 0.2 * (i % 4)], [1 + i % 2, 1 + (i // 2) % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_id string, dataset string, query string, score array<double>, slots array<int>")
    runs = Runs([("x",), ("y",)], ("system",), support=0)
    got = paired.slot_test(df, 0, 1, n_bootstrap=50, n_permutations=64).first()
    from pointsman.operators import metrics

    picks = metrics.slot_picks(df, ["m", "n"], runs).persist()
    a, b = (picks.where(F.col("system") == s) for s in "xy")
    test = paired.prediction_test(df, a, b, 50, 64, grouped=True).first()
    bound = paired.noninferiority(df, a, b, 0.5, 50, grouped=True).first()
    for c in ("macro_diff_pp", "bootstrap_ci_low_pp", "bootstrap_ci_high_pp", "permutation_p_two_sided", "n_queries", "n_inference_clusters", "query_wins"):
        assert got[c] == pytest.approx(test[c])
    assert got.lower_one_sided_pp == pytest.approx(bound.lower_one_sided_pp) and got.noninferior_A_to_B == bound.noninferior_A_to_B


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_files_are_hashed_by_blocks(spark, tmp_path, block):
    import hashlib

    (tmp_path / "a b").mkdir()
    contents = {"empty.bin": b"", "a b/odd 1%20+.bin": bytes(range(256)) * 41, "ö.bin": b"x" * 100}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = {(r.length, r.sha256) for r in tables.file_hashes(spark, str(tmp_path), block).collect()}
    # The reader lists no empty files.
    assert got == {(len(d), hashlib.sha256(d).hexdigest()) for d in contents.values() if d}


def test_files_of_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(b"abc")
    monkeypatch.setattr(tables, "_stream", lambda path: None)
    assert [r.length for r in tables.file_hashes(spark, str(tmp_path)).collect()] == [3]


def test_an_attempt_that_was_not_committed_counts_for_nothing(spark, tmp_path):
    """Rows that a job wrote before it died, and a run key that is no folder name."""
    at, key = str(tmp_path / "out"), "a=b/c %1"
    samples = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(6)], "sample_id string, query string")
    none = samples.select("sample_id").limit(0)
    assert tuple(enrich.enrich(samples, none, str.upper, at, run=key, slices=2).first()) == (6, 6, 0)
    left = [("s9", "T9", None, "ok", key, 0, "dead")]
    spark.createDataFrame(left, enrich.RESULT).write.mode("append").parquet(at)
    assert sorted(r.sample_id for r in enrich.results(spark, at).collect()) == [f"s{i}" for i in range(6)]
    assert tuple(enrich.enrich(samples, none, str.upper, at, run=key).first()) == (6, 6, 0)
    assert tuple(enrich.enrich(samples, none, str.upper, at, run="other").first()) == (0, 0, 0)


def test_a_result_file_is_read_once_however_many_numbers_it_holds(spark, tmp_path):
    """Numbers keep their text, over several lines too, and do not make the reader open the file again."""
    records = ",\n".join(f'{{"index": {i}.10, "prompt": "a\\nb",\n "score": {i % 2}, "cost": 1e-2, "prompt_tokens": 7}}' for i in range(2000))
    path = tmp_path / "d" / "s" / "m" / "a.json"
    path.parent.mkdir(parents=True)
    path.write_text('{"records": [\n' + records + "]\n}\n")
    (path.parent.parent / "n").mkdir()
    (path.parent.parent / "n" / "b.json").write_text('{"records": [')
    read = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = read()
    rows = results.load_records(spark, str(tmp_path)).orderBy("pos").collect()
    assert read() - before < 10 * path.stat().st_size
    assert [(r.dataset, r.model, r["index"], r.prompt, r.score, r.cost, r.prompt_tokens) for r in rows] == [
        ("d", "m", f"{i}.10", "a\nb", float(i % 2), 0.01, 7) for i in range(2000)
    ]
