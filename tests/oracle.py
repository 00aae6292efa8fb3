"""Run registered queries beside their SQL: `python -m tests.oracle [-s SF] [names...]`."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs between two results regardless of row order, or None. Values must be equal."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = _sorted(got.astype(object)), _sorted(want.astype(object))
    for c in a.columns:
        x, y = a[c], b[c]
        bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values of {c} differ, first:\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from pointsman.session import build_session

    sf = "0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv or list(queries):
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in sql:
                start = time.time()
                want = con.execute(sql[name]).df()
                problem = difference(got, want)
                note = f"sql {time.time() - start:.1f}s"
            else:
                problem, note = (None if len(got) else "no rows"), "rows only"
        except Exception as exc:  # noqa: BLE001 - report and go on
            took, problem, note = time.time() - start, f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {note} {'' if problem else len(got)}{problem or ''}", flush=True)
        spark.catalog.clearCache()
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
