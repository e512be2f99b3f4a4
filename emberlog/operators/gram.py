"""Weighted Gram matrix of feature vectors: the one data pass behind PCA and invariant mining."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Pairs of columns that a task of the Gram matrix holds before it sends them.
FLUSH = 2_000_000


def vector_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Arrow batches with their ``features`` stacked to a matrix."""
    for batch in batches:
        if len(batch):
            yield batch, np.vstack(batch["features"].to_numpy())


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The frame's schema plus the given ``name=type`` columns."""
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}
    return T.StructType([*df.schema.fields, *[T.StructField(c, kinds[k]) for c, k in columns.items()]])


def weighted_totals(vectors: DataFrame, size: int, total: Callable) -> np.ndarray:
    """Sum of ``total(matrix, weights)`` (``size`` numbers per block) over all vectors.

    Each partition adds up its blocks and sends one row; the sums are added by Spark.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for batch, matrix in vector_blocks(batches):
            part = np.asarray(total(matrix, batch["weight"].to_numpy(dtype=float)), dtype=float)
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"slot": np.arange(acc.size), "v": acc.ravel()})

    rows = vectors.select("features", "weight").mapInPandas(partial, "slot bigint, v double")
    out = np.zeros(size)
    for row in rows.groupBy("slot").agg(F.sum("v").alias("v")).toLocalIterator():
        out[row["slot"]] = row["v"]
    return out


def gram_rows(vectors: DataFrame) -> DataFrame:
    """``i, j, g`` with ``g = sum(weight * x_i * x_j)`` from ``features, weight``, for ``i <= j`` and ``g`` that arise.

    A task adds up the products of the entries that are not 0. It sends what it has when that has grown
    to ``FLUSH`` pairs of columns, so memory does not depend on the square of the vocabulary.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, sums = np.empty(0, dtype=np.int64), np.empty(0)

        def packed() -> pd.DataFrame:
            return pd.DataFrame({"i": codes // width, "j": codes % width, "g": sums})

        width = 1
        for batch, matrix in vector_blocks(batches):
            width = matrix.shape[1]
            weight = batch["weight"].to_numpy(dtype=float)
            if np.count_nonzero(matrix) * 4 > matrix.size:
                part = np.triu(matrix.T @ (matrix * weight[:, None]))
                i, j = np.nonzero(part)
                new_codes, new_sums = i * width + j, part[i, j]
            else:
                new_codes, new_sums = _pair_products(matrix, weight, width)
            codes, at = np.unique(np.concatenate([codes, new_codes]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([sums, new_sums]), minlength=len(codes))
            if len(codes) > FLUSH:
                yield packed()
                codes, sums = np.empty(0, dtype=np.int64), np.empty(0)
        if len(codes):
            yield packed()

    rows = vectors.select("features", "weight").mapInPandas(partial, "i bigint, j bigint, g double")
    return rows.groupBy("i", "j").agg(F.sum("g").alias("g"))


def _pair_products(matrix: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and sum of the weighted products of every two non-zero entries of a row (also of one with itself)."""
    row, col = np.nonzero(matrix)
    value = matrix[row, col]
    first = np.searchsorted(row, np.arange(len(matrix) + 1))
    codes, sums = [], []
    for shift in range(int(np.diff(first).max(initial=0))):
        # Entries and the ones ``shift`` places after them in the same row.
        a = np.arange(len(row) - shift)
        a = a[row[a] == row[a + shift]]
        b = a + shift
        codes.append(col[a] * width + col[b])
        sums.append(weight[row[a]] * value[a] * value[b])
    if not codes:
        return np.empty(0, dtype=np.int64), np.empty(0)
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(sums), minlength=len(found))


def gram_matrix(vectors: DataFrame, size: int) -> np.ndarray:
    """The Gram matrix on the driver: ``size`` is the vocabulary, not the data."""
    out = np.zeros((size, size))
    for row in gram_rows(vectors).toLocalIterator():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["g"]
    return out


def largest_eigenpairs(vectors: DataFrame, size: int, count: int, seed: int = 7, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of the Gram matrix and their directions (columns), without the matrix.

    Block Lanczos: each pass over the rows multiplies a few directions; the rest is the size of the
    directions found so far, which are kept orthogonal to each other.
    """
    width = min(size, max(4, min(count, 16)))
    rng = np.random.default_rng(seed)
    basis = np.empty((size, 0))
    images = np.empty((size, 0))
    block = np.linalg.qr(rng.standard_normal((size, width)))[0]
    while True:
        step = block
        image = weighted_totals(
            vectors, size * step.shape[1], lambda x, w, step=step: (x.T @ ((x @ step) * w[:, None])).ravel()
        ).reshape(size, step.shape[1])
        basis, images = np.column_stack([basis, block]), np.column_stack([images, image])
        values, inner = np.linalg.eigh(basis.T @ images)
        values, inner = values[::-1], inner[:, ::-1]
        have = min(count, len(values))
        residual = np.linalg.norm(images @ inner[:, :have] - (basis @ inner[:, :have]) * values[:have], axis=0)
        if basis.shape[1] >= size or (have == count and residual.max() <= tol * max(values[0], 1e-300)):
            return np.maximum(values[:have], 0.0), basis @ inner[:, :have]
        rest = image - basis @ (basis.T @ image)
        rest -= basis @ (basis.T @ rest)
        q, r = np.linalg.qr(rest)
        kept = np.abs(np.diag(r)) > 1e-10 * max(values[0], 1e-300)
        block = q[:, kept]
        if block.shape[1] == 0:  # the rows span no more; fill up with anything orthogonal
            extra = rng.standard_normal((size, min(width, size - basis.shape[1])))
            extra -= basis @ (basis.T @ extra)
            block = np.linalg.qr(extra - basis @ (basis.T @ extra))[0]
        block = block[:, : size - basis.shape[1]]
