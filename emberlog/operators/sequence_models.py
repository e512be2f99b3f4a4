"""Trained sequence models: per-position softmax for the next event, n-gram presence, plug-in scorer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from emberlog.functions.sequences import PAD
from emberlog.operators.seqwin import score_distinct

# Gram lengths of the supervised classifier.
GRAM_SIZES = (3, 4, 5)


def _position_tokens(contexts: DataFrame) -> DataFrame:
    """``_tokens``: one ``position=event`` token per context slot; padding has none."""
    named = F.transform("context", lambda e, i: F.concat(i.cast("string"), F.lit("="), e))
    return contexts.withColumn("_tokens", F.filter(named, lambda t: ~t.endswith(f"={PAD}"))).withColumn(
        "_events", F.filter("context", lambda e: e != PAD)
    )


@dataclass
class NextEventSoftmax:
    """Multinomial regression of the next event on the context's slots (and its event counts)."""

    vocab: list[str]
    model: PipelineModel

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        h: int,
        vocab: list[str],
        with_counts: bool = False,
        reg_param: float = 0.001,
        max_iter: int = 25,
    ) -> NextEventSoftmax:
        """``train``: ``context, next`` and optionally ``weight``."""
        weight = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
        slots = [f"{i}={e}" for i in range(h) for e in vocab]
        stages = [CountVectorizerModel.from_vocabulary(slots, "_tokens", "_slots")]
        inputs = ["_slots"]
        if with_counts:
            stages.append(CountVectorizerModel.from_vocabulary(vocab, "_events", "_counts"))
            inputs.append("_counts")
        stages.append(VectorAssembler(inputCols=inputs, outputCol="_v"))
        stages.append(
            LogisticRegression(
                featuresCol="_v",
                labelCol="_label",
                weightCol="_weight",
                probabilityCol="_p",
                family="multinomial",
                regParam=reg_param,
                maxIter=max_iter,
                standardization=False,
            )
        )
        index = F.array_position(F.array(*[F.lit(v) for v in vocab]), F.col("next")) - 1
        known = train.select("context", "next", weight.alias("_weight"))
        table = _position_tokens(known).select("_tokens", "_events", index.cast("double").alias("_label"), "_weight")
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return cls(vocab, Pipeline(stages=stages).fit(table))
        finally:
            table.unpersist()

    def ahead(self, wins: DataFrame) -> DataFrame:
        """Windows plus ``ahead``: symbols strictly more probable than the next event.

        Each distinct context is scored once.
        """

        def scorer(contexts: DataFrame) -> DataFrame:
            out = self.model.transform(_position_tokens(contexts))
            return out.select("context", vector_to_array("_p").alias("_p"))

        scored = score_distinct(wins, "context", scorer)
        place = F.array_position(F.array(*[F.lit(v) for v in self.vocab]), F.col("next"))
        target = F.coalesce(F.get("_p", (place - 1).cast("int")), F.lit(0.0))
        ahead = F.size(F.filter("_p", lambda q: q > F.col("_target")))
        return scored.withColumn("_target", target).withColumn("ahead", ahead).drop("_p", "_target")

    def hits(self, wins: DataFrame, g: int) -> DataFrame:
        return self.ahead(wins).withColumn("hit", F.col("ahead") < g)


def gram_presence(sequences: DataFrame) -> DataFrame:
    """``session_id, grams``: distinct 3-, 4- and 5-grams of ``events``; none touches padding."""
    real = F.filter("events", lambda e: e != PAD)

    def runs(n: int):
        cut = F.transform(
            F.sequence(F.lit(1), F.size("_real") - F.lit(n - 1)),
            lambda i: F.array_join(F.slice("_real", i, F.lit(n)), " "),
        )
        return F.when(F.size("_real") >= n, cut).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.concat(*[runs(n) for n in GRAM_SIZES]))
    return sequences.withColumn("_real", real).withColumn("grams", grams).drop("_real", "events")


def score_with(
    wins: DataFrame, encoded: str, make_predict: Callable, width: int, batch_size: int = 4096
) -> DataFrame:
    """Add ``score`` by a user-supplied batch predictor over the distinct encoded windows.

    ``make_predict()`` runs once per Python worker and returns ``fn(matrix) -> vector``.
    """
    udf = predict_batch_udf(
        make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    return score_distinct(wins, encoded, lambda d: d.withColumn("score", udf(F.col(encoded))))


def linear_predictor(weights: list[float]) -> Callable:
    """A small ready predictor: a weighted sum of the encoded slots."""

    def make():
        w = np.asarray(weights, dtype=float)
        return lambda matrix: np.asarray(matrix, dtype=float) @ w

    return make
