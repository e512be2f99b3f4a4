"""Sliding-window event counts and labels on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(
    events: DataFrame, window_hours: int, step_hours: int, lateness: str = "1 hour", time: str = "ts"
) -> DataFrame:
    """``start, event, cnt, bad`` per calendar window; rows later than ``lateness`` are dropped."""
    slot = F.window(time, f"{window_hours} hours", f"{step_hours} hours")
    return (
        events.withWatermark(time, lateness)
        .groupBy(slot.alias("w"), "event")
        .agg(F.count(F.lit(1)).alias("cnt"), F.max("bad").alias("bad"))
        .select(F.col("w.start").alias("start"), "event", "cnt", "bad")
    )
