"""Residual-subspace detector: large residual after projection on the main components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.gram import gram_matrix, gram_rows, largest_eigenpairs, vector_blocks, widened
from emberlog.session import stage

# Standard normal quantiles by significance level.
C_ALPHA = {
    0.08: 1.7507,
    0.05: 1.9600,
    0.01: 2.5758,
    0.005: 2.807,
    0.003: 2.9677,
    0.001: 3.2905,
    0.0005: 3.4808,
    0.0001: 3.8906,
    0.00001: 4.4172,
}


# Columns up to which second moments may be a matrix on the driver.
DENSE = 2_000


def component_count(sigma: np.ndarray, n_components: float) -> int:
    """A number of components, or the smallest one whose share of the total reaches a ratio."""
    if n_components >= 1:
        return int(n_components)
    shares = np.cumsum(sigma) / np.sum(sigma)
    return int(min(np.searchsorted(shares, n_components, side="left") + 1, sigma.size))


def q_threshold(residual: np.ndarray, c_alpha: float) -> float:
    """Residual threshold from the variances left out (0 if nothing is left out)."""
    return q_threshold_of(*(float(np.sum(residual**p)) for p in (1, 2, 3)), c_alpha)


def q_threshold_of(phi1: float, phi2: float, phi3: float, c_alpha: float) -> float:
    """The same from the sums of the first three powers of the variances left out."""
    if phi2 <= 0 or phi1 <= 0:
        return 0.0
    h0 = 1.0 - 2.0 * phi1 * phi3 / (3.0 * phi2**2)
    spread = c_alpha * np.sqrt(2.0 * phi2 * h0**2) / phi1
    return float(phi1 * (spread + 1.0 + phi2 * h0 * (h0 - 1.0) / phi1**2) ** (1.0 / h0))


@dataclass
class PcaModel:
    """``main``: the kept directions as columns; a row is scored by what is left without them."""

    main: np.ndarray
    threshold: float

    @property
    def n_components(self) -> int:
        return self.main.shape[1]

    @property
    def projector(self) -> np.ndarray:
        """The residual projector as a matrix, for small vocabularies."""
        size, kept = self.main.shape
        return np.eye(size) - self.main @ self.main.T if kept < size else np.zeros((size, size))

    @classmethod
    def fit(
        cls,
        vectors: DataFrame,
        size: int,
        n_components: float = 0.95,
        threshold: float | None = None,
        c_alpha: float = C_ALPHA[0.001],
        dense: int = DENSE,
    ) -> PcaModel:
        """Fit on ``features, weight`` (uncentred second moments).

        Up to ``dense`` columns the moments are a matrix on the driver. Beyond, only the kept directions
        are computed, in passes over the rows; what the threshold needs of the others are the traces of
        the first three powers of the moments, which are sums over the sparse table of moments.
        """
        n = vectors.agg(F.sum("weight").alias("n")).first()["n"]
        if size <= dense:
            u, sigma, _ = np.linalg.svd(gram_matrix(vectors, size) / n)
            kept = component_count(sigma, n_components)
            limit = q_threshold(sigma[kept:], c_alpha) if threshold is None else float(threshold)
            return cls(u[:, :kept], limit)
        return cls._fit_wide(vectors, size, n, n_components, threshold, c_alpha)

    @classmethod
    def _fit_wide(cls, vectors, size, n, n_components, threshold, c_alpha) -> PcaModel:
        upper = stage(gram_rows(vectors).withColumn("g", F.col("g") / F.lit(n)), "moments")
        moments = upper.unionByName(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "g"))
        trace = upper.where("i = j").agg(F.sum("g").alias("t")).first()["t"] or 0.0
        count = int(n_components) if n_components >= 1 else 8
        while True:
            count = min(count, size)
            values, directions = largest_eigenpairs(vectors, size, count)
            values = values / n
            shares = np.cumsum(values) / max(trace, 1e-300)
            if n_components >= 1 or shares[-1] >= n_components or count == size:
                break
            count *= 2
        kept = count if n_components >= 1 else int(min(np.searchsorted(shares, n_components, side="left") + 1, count))
        if threshold is None:
            square = moments.agg(F.sum(F.col("g") * F.col("g")).alias("t")).first()["t"]
            other = moments.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("g").alias("h"))
            twice = moments.join(other, "j").groupBy("i", "k").agg(F.sum(F.col("g") * F.col("h")).alias("s"))
            cube = twice.join(moments.withColumnRenamed("j", "k"), ["i", "k"]).agg(F.sum(F.col("s") * F.col("g")).alias("t")).first()["t"]
            own = values[:kept]
            phi = [max(total - float(np.sum(own**p)), 0.0) for p, total in ((1, trace), (2, square), (3, cube))]
            threshold = q_threshold_of(*phi, c_alpha)
        return cls(directions[:, :kept], float(threshold))

    def score(self, vectors: DataFrame) -> DataFrame:
        """Add ``spe``, the squared length of the residual, and ``pred``."""
        main, limit = self.main, self.threshold
        # With every direction kept nothing is left over; rounding must not look like a residual.
        whole = main.shape[1] >= main.shape[0]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch, matrix in vector_blocks(batches):
                rest = np.zeros_like(matrix) if whole else matrix - (matrix @ main) @ main.T
                spe = np.einsum("ij,ij->i", rest, rest)
                yield batch.assign(spe=spe, pred=(spe > limit).astype("int32"))

        return vectors.mapInPandas(run, widened(vectors, spe="double", pred="int"))

    def write(self, path: str, spark: SparkSession) -> None:
        rows = [(i, [float(v) for v in row], float(self.threshold)) for i, row in enumerate(self.main)]
        spark.createDataFrame(rows, "i int, row array<double>, threshold double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PcaModel:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["i"])
        return cls(np.array([r["row"] for r in rows]), rows[0]["threshold"])
