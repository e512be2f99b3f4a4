"""Decision rules, confusion counts, precision / recall / F1 and the best-F1 boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.order import running_sums


def symbols_ahead(target: Column, _total: Column, weights: Column) -> Column:
    """How many symbols weigh strictly more than the target; the target is among the top g
    (ties pass) exactly if this is below g."""
    return F.size(F.filter(weights, lambda q: q > target))


def session_verdict(scored: DataFrame, max_mismatch_rate: float = 0.0) -> DataFrame:
    """``session_id, mismatches, n_windows, pred`` from window rows with a boolean ``hit``."""
    miss = F.sum((~F.col("hit")).cast("int"))
    return (
        scored.groupBy("session_id")
        .agg(miss.alias("mismatches"), F.count(F.lit(1)).alias("n_windows"))
        .withColumn(
            "pred", (F.col("mismatches") / F.col("n_windows") > F.lit(float(max_mismatch_rate))).cast("int")
        )
    )


def _known(name: str) -> Column:
    """The column, or an error where it is null: a session must not drop out of the counts."""
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"{name} is null")).cast("double"))


def confusion(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``tp, tn, fp, fn`` from ``label`` and ``pred``; rows count ``weight`` times. Nulls are an error."""
    flagged, bad = _known("pred") == 1, _known("label") > 0
    times = F.col(weight) if weight else F.lit(1)

    def n(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, times).otherwise(F.lit(0)).cast("bigint")), F.lit(0))

    return scored.groupBy(*by).agg(
        n(flagged & bad).alias("tp"),
        n(~flagged & ~bad).alias("tn"),
        n(flagged & ~bad).alias("fp"),
        n(~flagged & bad).alias("fn"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1; an empty denominator gives 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
    )


def evaluate(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return precision_recall_f1(confusion(scored, by, weight))


def _no_anomaly(like: Column) -> Column:
    """An error with the type of ``like``."""
    return F.when(F.raise_error(F.lit("no anomalous session to place a boundary by")).cast("boolean"), like)


def best_boundary(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row ``boundary, precision, recall, f1``: flag ``score <= boundary`` for the best F1.

    Candidates are the scores of anomalous sessions; of equally good ones the smallest wins.
    Without any anomalous session there is no boundary, which is an error.
    """
    bad = (F.col("label") > 0).cast("bigint")
    per_score = scores.groupBy(F.col(score).alias("score")).agg(
        F.sum(bad).alias("anom"), F.sum(1 - bad).alias("norm")
    )
    summed = running_sums(per_score, "score", ["anom", "norm"])
    cost = (F.col("all_anom") + F.col("cum_norm")) / F.col("cum_anom")
    best = F.min_by(F.struct("score", "cum_anom", "cum_norm", "all_anom"), F.struct(cost, F.col("score")))
    precision = F.col("b.cum_anom") / (F.col("b.cum_anom") + F.col("b.cum_norm"))
    recall = F.col("b.cum_anom") / F.col("b.all_anom")
    return (
        summed.where(F.col("anom") > 0)
        .agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
        .withColumn("b", F.when(F.col("n") > 0, F.col("b")).otherwise(_no_anomaly(F.col("b"))))
        .select(
            F.col("b.score").alias("boundary"),
            precision.alias("precision"),
            recall.alias("recall"),
            (2 * precision * recall / (precision + recall)).alias("f1"),
        )
    )


def apply_boundary(scores: DataFrame, boundary: Column, score: str = "score") -> DataFrame:
    """Flag sessions at or below the boundary."""
    return scores.withColumn("pred", (F.col(score) <= boundary).cast("int"))


def select_by_f1(reports: DataFrame) -> DataFrame:
    """The candidate with the best F1; the earliest ``candidate_no`` wins a tie."""
    return reports.agg(
        F.max_by(F.struct("candidate_no", "candidate", "f1"), F.struct("f1", -F.col("candidate_no"))).alias("b")
    ).select("b.*")
