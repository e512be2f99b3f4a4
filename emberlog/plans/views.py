"""Shared intermediate frames of the registered plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import seqwin, sessions, split
from emberlog.plans import fixtures
from emberlog.session import stage

# Model sizes used by the registered plans on long (user) and short (day) sessions.
H = 4
TRAIN, TEST = 0.35, 0.6
G = 5
MAX_MISMATCH = 0.65


def text(events: str | Column, sep: str = ",") -> Column:
    return F.array_join(events, sep)


def r6(value: str | Column) -> Column:
    """A double rounded for comparison, without negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def user_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_heads(fixtures.user_rows(spark, sf_dir), "bad")


def day_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_heads(fixtures.day_rows(spark, sf_dir), "bad")


def user_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_chunks(sessions.with_positions(fixtures.user_rows(spark, sf_dir)))


def day_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_chunks(sessions.with_positions(fixtures.day_rows(spark, sf_dir)))


def user_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_uniform(user_heads(spark, sf_dir), TRAIN, TEST).select("session_id", "label", "split")


def day_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_uniform(day_heads(spark, sf_dir), TRAIN, TEST).select("session_id", "label", "split")


def user_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of user sessions with ``label`` and ``split``, written once: every later step reads them."""
    return stage(user_chunks(spark, sf_dir).join(user_split(spark, sf_dir), "session_id"), "user-sequences")


def day_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(day_chunks(spark, sf_dir).join(day_split(spark, sf_dir), "session_id"), "day-sequences")


def padded_windows(sequences: DataFrame, width: int) -> DataFrame:
    """Windows of left-padded sessions."""
    return seqwin.windows(seqwin.padded_left(sequences, width), width)
