"""Outcomes of candidates as they arrive: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome_monitor(rows: DataFrame, time: str, candidate: str, score: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, end, candidate, n, mean_score, least, most) of every closed tumbling window.

    The watermark runs `delay` behind the latest time seen. In append mode a window is emitted once, when the watermark
    passes its end; a row that arrives for a window already closed is dropped. State holds the open windows only, one sum
    per candidate, however many rows they have. Rows without a time are left out, a null score counts in n but not in the mean.
    Times without a zone are taken in the session's zone.
    """
    timed = rows.select(F.col(time).cast("timestamp").alias("_at"), F.col(candidate).alias("candidate"), F.col(score).cast("double").alias("_score"))
    seen = timed.where("_at is not null").withWatermark("_at", delay).groupBy(F.window("_at", width).alias("w"), "candidate")
    out = seen.agg(F.count("*").alias("n"), F.avg("_score").alias("mean_score"), F.min("_score").alias("least"), F.max("_score").alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "candidate", "n", "mean_score", "least", "most")


def drifted(windows: DataFrame, baseline: DataFrame, least: float) -> DataFrame:
    """Closed windows whose mean falls short of the candidate's baseline (candidate, base) by more than `least`."""
    fall: Column = F.col("base") - F.col("mean_score")
    # A row per candidate.
    return windows.join(F.broadcast(baseline), "candidate").withColumn("fall", fall).where(F.col("fall") > least)
