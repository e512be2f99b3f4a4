"""Supervised detectors on weighted distinct vectors: logistic regression, linear SVM, decision tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from emberlog.operators.features import class_weights
from emberlog.operators.gram import weighted_totals


def training_table(vectors: DataFrame, class_weight="none") -> DataFrame:
    """``features, label, weight`` distinct rows; ``weight`` includes the class weight."""
    weighted = vectors.groupBy("features", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if class_weight in (None, "none"):
        return weighted
    marked = class_weights(weighted, class_weight)
    return marked.withColumn("weight", F.col("weight") * F.col("class_weight")).drop("class_weight")


def _with_bias(vectors: DataFrame) -> DataFrame:
    """ML vector column with a constant last slot, so the offset is penalised like a weight."""
    return vectors.withColumn("_v", array_to_vector(F.concat("features", F.array(F.lit(1.0)))))


def _plain(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("_v", array_to_vector("features"))


@dataclass
class Classifier:
    """A fitted ML model with the vector layout it was trained on."""

    model: object
    bias: bool

    def predict(self, vectors: DataFrame) -> DataFrame:
        """Add ``pred``."""
        shaped = _with_bias(vectors) if self.bias else _plain(vectors)
        out = self.model.transform(shaped)
        return out.select(*vectors.columns, F.col("_pred").cast("int").alias("pred"))


def _fit(estimator, table: DataFrame, bias: bool) -> Classifier:
    shaped = (_with_bias(table) if bias else _plain(table)).withColumn("label", F.col("label").cast("double"))
    shaped = shaped.select("_v", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Classifier(estimator.fit(shaped), bias)
    finally:
        shaped.unpersist()


def logistic_regression(
    vectors: DataFrame, penalty: str = "l2", c: float = 100.0, tol: float = 0.01, class_weight=None, max_iter: int = 100
) -> Classifier:
    table = training_table(vectors, class_weight)
    total = table.agg(F.sum("weight").alias("n")).first()["n"]
    estimator = LogisticRegression(
        featuresCol="_v",
        predictionCol="_pred",
        weightCol="weight",
        regParam=1.0 / (c * total),
        elasticNetParam={"l1": 1.0, "l2": 0.0}[penalty],
        tol=tol,
        maxIter=max_iter,
        standardization=False,
        fitIntercept=False,
    )
    return _fit(estimator, table, bias=True)


def linear_svm(vectors: DataFrame, c: float = 1.0, tol: float = 0.1, class_weight=None, max_iter: int = 100) -> Classifier:
    """Hinge loss with an L2 penalty."""
    table = training_table(vectors, class_weight)
    total = table.agg(F.sum("weight").alias("n")).first()["n"]
    estimator = LinearSVC(
        featuresCol="_v",
        predictionCol="_pred",
        weightCol="weight",
        regParam=1.0 / (c * total),
        tol=tol,
        maxIter=max_iter,
        standardization=False,
    )
    return _fit(estimator, table, bias=False)


def decision_tree(
    vectors: DataFrame, criterion: str = "gini", max_depth: int | None = None, max_features=None, class_weight=None
) -> Classifier:
    """``max_depth=None`` uses the deepest tree available (30)."""
    shared = {
        "featuresCol": "_v",
        "predictionCol": "_pred",
        "weightCol": "weight",
        "impurity": criterion,
        "maxDepth": 30 if max_depth is None else max_depth,
    }
    if max_features is None:
        estimator = DecisionTreeClassifier(**shared)
    else:
        estimator = RandomForestClassifier(
            **shared, numTrees=1, featureSubsetStrategy=str(max_features), subsamplingRate=1.0, bootstrap=False
        )
    return _fit(estimator, training_table(vectors, class_weight), bias=False)


@dataclass
class SparseSvm:
    """Linear SVM with squared hinge loss and an L1 penalty; the last weight is the offset."""

    weights: np.ndarray

    @classmethod
    def fit(
        cls, vectors: DataFrame, size: int, c: float = 1.0, tol: float = 0.1, class_weight=None, max_iter: int = 100
    ) -> SparseSvm:
        """Orthant-wise L-BFGS. Each round takes two Spark aggregates: the slope of the loss at the
        current weights (a number per column from each partition), and the loss at several step lengths.

        Ends when the least subgradient is ``tol`` times what it was at the start.
        """
        table = training_table(vectors, class_weight)
        signed = F.when(F.col("label") > 0, 1.0).otherwise(-1.0)
        # Rows enter as y * (x, 1): the margin of a row is its product with the weights.
        rows = table.select(
            F.transform(F.concat("features", F.array(F.lit(1.0))), lambda x: x * signed).alias("features"), "weight"
        ).persist(StorageLevel.MEMORY_AND_DISK)
        k = size + 1

        def losses(points: np.ndarray) -> np.ndarray:
            loss = weighted_totals(
                rows, len(points), lambda x, w: c * (w @ np.maximum(1.0 - x @ points.T, 0.0) ** 2)
            )
            return loss + np.abs(points).sum(axis=1)

        def slope(at: np.ndarray) -> np.ndarray:
            return weighted_totals(rows, k, lambda x, w: -2.0 * c * ((w * np.maximum(1.0 - x @ at, 0.0)) @ x))

        try:
            at, history = np.zeros(k), []
            value, down = losses(at[None, :])[0], slope(at)
            start = None
            for _ in range(max_iter):
                steepest = least_subgradient(at, down)
                start = np.abs(steepest).max() if start is None else start
                if np.abs(steepest).max() <= tol * max(start, 1e-12):
                    break
                direction = _quasi_newton(steepest, history)
                direction[direction * steepest >= 0] = 0.0
                orthant = np.where(at != 0, np.sign(at), -np.sign(steepest))
                first = 1.0 if history else 1.0 / np.abs(steepest).sum()
                points = np.array([at + direction * first * 0.5**i for i in range(-2, 14)])
                points[np.sign(points) != orthant] = 0.0
                tried = losses(points)
                best = int(np.argmin(tried))
                if tried[best] >= value:
                    if not history:
                        break
                    history = []  # the model of the curvature misled; start from the slope again
                    continue
                new_down = slope(points[best])
                step, change = points[best] - at, new_down - down
                if step @ change > 1e-12 * (change @ change):
                    history = [*history[-7:], (step, change)]
                at, value, down = points[best], tried[best], new_down
            return cls(at)
        finally:
            rows.unpersist()

    def write(self, path: str, spark: SparkSession) -> None:
        spark.createDataFrame([([float(w) for w in self.weights],)], "weights array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseSvm:
        return cls(np.array(spark.read.parquet(path).first()["weights"]))

    def predict(self, vectors: DataFrame) -> DataFrame:
        """Add ``margin`` and ``pred``."""
        parts = F.array(*[F.lit(float(v)) for v in self.weights[:-1]])
        products = F.zip_with("features", parts, lambda x, v: x * v)
        margin = F.aggregate(products, F.lit(float(self.weights[-1])), lambda a, x: a + x)
        return vectors.withColumn("margin", margin).withColumn("pred", (F.col("margin") > 0).cast("int"))


def least_subgradient(at: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The smallest subgradient of a loss with this slope plus the sum of the sizes of the weights."""
    pull = np.sign(slope) * np.maximum(np.abs(slope) - 1.0, 0.0)
    return np.where(at != 0, slope + np.sign(at), pull)


def _quasi_newton(slope: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A descent direction from the last (step, change of slope) pairs, newest last."""
    q, alphas = -slope, []
    for step, change in reversed(history):
        alphas.append((step @ q) / (step @ change))
        q = q - alphas[-1] * change
    if history:
        step, change = history[-1]
        q = q * (step @ change) / (change @ change)
    for (step, change), alpha in zip(history, reversed(alphas), strict=True):
        q = q + (alpha - (change @ q) / (step @ change)) * step
    return q
