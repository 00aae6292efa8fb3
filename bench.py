"""Headline queries, timed once each after one untimed run of the first; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pointsman.catalog.load import QUERIES  # noqa: E402
from pointsman.session import build_session  # noqa: E402

HEADLINE = (
    "benchmark_metrics", "main_table", "routing_metrics", "complete_case_filter", "drop_dup_keep_last", "split_priority_dedup",
    "id_split_grouped", "stratified_folds_grouped", "encode_answer", "rep_probability_mass", "tfidf_features",
    "risk_coverage_curve", "select_threshold", "lambda_sweep", "self_join_pareto", "fit_ridge", "oof_evaluate",
    "paired_bootstrap_ci", "paired_permutation_p", "ingest_generic",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["benchmark_metrics"](spark, sf_dir).collect()
    spark.catalog.clearCache()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
