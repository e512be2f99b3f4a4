"""The flagship plan: next-event anomaly detection from event rows to precision / recall / F1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import evaluate, seqwin
from emberlog.operators.nextevent import NextEventModel
from emberlog.plans import views


def train_windows(sequences: DataFrame) -> DataFrame:
    """Distinct ``context, next`` of normal training sessions: repeated windows are trained on once."""
    normal = views.padded_windows(sequences.where("split = 'train' and label = 0"), views.H + 1)
    return seqwin.with_context(normal, views.H).select("context", "next").distinct()


def next_event_windows(spark: SparkSession, sf_dir: str, part: str) -> tuple[DataFrame, NextEventModel, DataFrame]:
    """Windows of one split, the fitted model, and the sequences both come from."""
    sequences = views.user_sequences(spark, sf_dir)
    model = NextEventModel.fit(train_windows(sequences), views.H).staged()
    asked = views.padded_windows(sequences.where(F.col("split") == part), views.H + 1)
    return seqwin.with_context(asked, views.H), model, sequences


def next_event_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, mismatches, n_windows, pred, label`` of the test sessions."""
    wins, model, sequences = next_event_windows(spark, sf_dir, "test")
    verdict = evaluate.session_verdict(model.hits(wins, views.G), views.MAX_MISMATCH)
    labels = sequences.where("split = 'test' and chunk = 0").select("session_id", "label")
    return verdict.join(labels, "session_id")


def next_event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate.evaluate(next_event_scored(spark, sf_dir))
    return report.select(
        "tp", "tn", "fp", "fn", *[views.r6(c).alias(c) for c in ("precision", "recall", "f1")]
    )
