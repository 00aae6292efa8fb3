"""Registration of queries together with their output columns and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointsman.catalog.sql import compile_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(re.split(r"\s+", part.strip())) for part in spec.split(",")]


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "i":
        return c.cast("long").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    # Adding 0 turns a negative zero into a plain one.
    return (F.round(c.cast("double"), int(kind)) + F.lit(0.0)).alias(name)


def _sql_column(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "b":
        return f"CAST({q} AS BOOLEAN) AS {q}"
    if kind == "s":
        return f"CAST({q} AS VARCHAR) AS {q}"
    return f"round(CAST({q} AS DOUBLE), {kind}) + CAST(0 AS DOUBLE) AS {q}"


def query(name: str, spec: str, sql: str | None = None):
    """Register a query. `spec` lists its columns as `name kind`.

    Kinds: i whole number, s text, b truth value, or the decimals a number is rounded to,
    since sums run in another order in another engine.
    """
    columns = _columns(spec)

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_column(n, k) for n, k in columns])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = compile_sql(sql, ", ".join(_sql_column(n, k) for n, k in columns))
        return fn

    return wrap
