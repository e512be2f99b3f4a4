"""Outcome buckets of scored sessions: tag, sample, expand to templates, render as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.lookup import encoded

# Bucket names.
OUTCOMES = ("tp", "tn", "fp", "fn")


def tag_outcomes(scored: DataFrame, enabled: Sequence[str] = OUTCOMES) -> DataFrame:
    """Add ``outcome`` and keep the enabled buckets."""
    flagged, bad = F.col("pred") == 1, F.col("label") > 0
    outcome = (
        F.when(flagged & bad, "tp").when(flagged, "fp").when(bad, "fn").otherwise("tn")
    )
    return scored.withColumn("outcome", outcome).where(F.col("outcome").isin(list(enabled)))


def sample_outcomes(tagged: DataFrame, sample: int | None = 100) -> DataFrame:
    """The first ``sample`` sessions of each bucket by first appearance (``None`` or 0: all)."""
    if not sample:
        return tagged
    order = Window.partitionBy("outcome").orderBy("first_line", "session_id")
    return tagged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).drop("_n")


def expand_templates(chunks: DataFrame, templates: DataFrame) -> DataFrame:
    """Events of chunks (``session_id, chunk``) as ``"<id> <template>"``; an id without template is an error."""
    named = F.concat_ws(" ", "EventId", "EventTemplate").alias("value")
    unknown = F.raise_error(F.concat(F.lit("no template for event "), F.col("event"))).cast("string")
    return encoded(chunks, "events", templates.select(F.col("EventId").alias("event"), named), ["session_id", "chunk"], unknown)


def render(chunks: DataFrame, one_event_per_line: bool = False) -> DataFrame:
    """``outcome, text``: a session on one line, or one event per line with a blank line after.

    A session longer than a chunk goes on in the next row.
    """
    if not one_event_per_line:
        return chunks.withColumn("text", F.array_join("events", " "))
    ends = chunks.groupBy("session_id").agg(F.max("chunk").alias("_last"))
    blank = F.when(F.col("chunk") == F.col("_last"), F.lit("\n")).otherwise(F.lit(""))
    text = F.concat(F.array_join("events", "\n"), blank)
    return chunks.join(ends, "session_id").withColumn("text", text).drop("_last")
