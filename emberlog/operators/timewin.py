"""Sliding time windows over a time-ordered event log.

``exact`` mode follows the index-walking definition: the first window covers ``W`` seconds
from the first row, later windows end a step after the previous *last row* and there is no
window at all if the log is shorter than ``W``. Each row computes the range of windows it
belongs to, so membership is one narrow explode. ``grid`` mode is the calendar grid.

Input rows: ``line_no``, ``t`` (whole seconds, rising with ``line_no``), ``event``, ``bad``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.order import LINE_BUCKET, line_bucket, rank_in_order

HOUR = 3600


@dataclass
class WindowPlan:
    """The few numbers that fix all windows: first time, end of the first window's rows, last index."""

    width: int
    step: int
    first: int
    first_end: int
    last: int  # index of the last window; -1 if there is none

    @classmethod
    def of(cls, rows: DataFrame, window_hours: float, step_hours: float) -> WindowPlan:
        width, step = int(window_hours * HOUR), int(step_hours * HOUR)
        if width <= 0 or step <= 0:
            raise ValueError("window and step must be positive")
        span = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
        if span["lo"] is None or span["hi"] < span["lo"] + width:
            return cls(width, step, span["lo"] or 0, span["lo"] or 0, -1)
        end = rows.where(F.col("t") < span["lo"] + width).agg(F.max("t").alias("e")).first()["e"]
        return cls(width, step, span["lo"], end, (span["hi"] - end) // step + 1)


def members(rows: DataFrame, plan: WindowPlan) -> DataFrame:
    """``win`` plus the row's columns, once per window the row is in."""
    t, step = F.col("t"), F.lit(plan.step)
    past_end = F.floor((t - F.lit(plan.first_end)) / step) + 1
    since_start = F.floor((t - F.lit(plan.first)) / step)
    low = F.greatest(F.lit(1), past_end)
    late = F.when(t > plan.first_end, past_end).otherwise(F.lit(0))
    high = F.least(F.lit(plan.last), F.greatest(since_start, late))
    none = F.array().cast("array<bigint>")
    later = F.when(low <= high, F.sequence(low, high)).otherwise(none)
    first = F.when(t < plan.first + plan.width, F.array(F.lit(0).cast("bigint"))).otherwise(none)
    found = F.concat(first, later) if plan.last >= 0 else none
    return rows.select(F.explode(found).alias("win"), *rows.columns)


def all_windows(rows: DataFrame, plan: WindowPlan) -> DataFrame:
    return rows.sparkSession.range(plan.last + 1).withColumnRenamed("id", "win")


def bounds(rows: DataFrame, plan: WindowPlan, width: int = LINE_BUCKET) -> DataFrame:
    """``win, start_index, end_index`` (end exclusive) as row numbers in time order."""
    ranked = rank_in_order(rows, line_bucket("line_no", width), ["line_no"], out="row_no")
    found = members(ranked, plan).groupBy("win").agg(
        F.min("row_no").alias("start_index"), (F.max("row_no") + 1).alias("end_index")
    )
    # One row per window: an empty one starts and ends where the last filled one ended.
    earlier = Window.orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    filled = all_windows(rows, plan).join(found, "win", "left")
    end = F.last("end_index", ignorenulls=True).over(earlier)
    return filled.select("win", F.coalesce("start_index", end).alias("start_index"), end.alias("end_index"))


def members_from_bounds(rows: DataFrame, table: DataFrame, block: int = 4096) -> DataFrame:
    """Membership from stored bounds: windows and rows meet on blocks of row numbers."""
    ranked = rank_in_order(rows, line_bucket("line_no"), ["line_no"], out="row_no")
    low, high = F.floor(F.col("start_index") / block), F.floor((F.col("end_index") - 1) / block)
    spread = table.where("end_index > start_index").select("*", F.explode(F.sequence(low, high)).alias("_block"))
    return (
        ranked.withColumn("_block", F.floor(F.col("row_no") / block))
        .join(spread, "_block")
        .where((F.col("row_no") >= F.col("start_index")) & (F.col("row_no") < F.col("end_index")))
        .select("win", *rows.columns)
    )


def counts(found: DataFrame) -> DataFrame:
    """``win, event, cnt``."""
    return found.groupBy("win", "event").agg(F.count(F.lit(1)).alias("cnt"))


def labels(found: DataFrame, every: DataFrame) -> DataFrame:
    """``win, label``: 1 where a member is bad; empty windows are normal."""
    marked = found.groupBy("win").agg(F.max("bad").cast("int").alias("label"))
    return every.join(marked, "win", "left").select("win", F.coalesce("label", F.lit(0)).alias("label"))


def summary(found: DataFrame, every: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: windows, distinct events, anomalous windows."""
    events = rows.agg(F.count_distinct("event").alias("n")).scalar()
    return labels(found, every).agg(
        F.count(F.lit(1)).alias("windows"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("anomalies"),
        F.max(events).alias("events"),
    )


def grid_counts(rows: DataFrame, window_hours: int, step_hours: int, time: str = "ts") -> DataFrame:
    """Counts on the calendar grid: ``start`` (window start), event, cnt and the window's label part."""
    slot = F.window(time, f"{window_hours} hours", f"{step_hours} hours")
    return (
        rows.groupBy(slot.alias("w"), "event")
        .agg(F.count(F.lit(1)).alias("cnt"), F.max("bad").alias("bad"))
        .select(F.col("w.start").alias("start"), "event", "cnt", "bad")
    )
