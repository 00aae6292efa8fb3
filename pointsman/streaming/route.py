"""Routing of queries as they arrive: the one-query path of a live router as a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pointsman.operators import linear, routing


def scan_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def route(features: DataFrame, coefs: np.ndarray, models: list[str], top_k: int = 5) -> DataFrame:
    """Ranked candidates per arriving row of (sample_id, x); row by row, so no state is kept."""
    return routing.ranked(linear.score(features, "x", coefs), models, top_k)


def sink(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append to parquet. The checkpoint makes a restart continue without repeats."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()
