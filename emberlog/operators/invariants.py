"""Linear invariants between event counts, mined level by level.

Candidate column sets are a table. A level joins the sets that failed before on their common prefix,
keeps those whose parts are all open, and gets integer weights from one decomposition per set of its
block of the Gram matrix. Bounds from second moments and co-occurrence drop sets that cannot hold on
enough rows; for the others the rows that fit are counted in a grid of stripes of vectors and of sets.
Only sets that hold reach the driver, in order, until enough are accepted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.gram import gram_matrix, weighted_totals
from emberlog.session import stage

# Numeric tolerances and the integer scales tried for a weight vector.
ZERO_WEIGHT = 1e-6
ZERO_FIT = 1e-8
ANOMALY_SUM = 1e-6
SCALES = (1, 2, 3)

Columns = tuple[int, ...]

# Vectors in one task of the grid, and bytes of one of its stripes of candidates or of one product.
STRIPE = 50_000
STRIPE_BYTES = 16 << 20


def space_dimension(vectors: DataFrame, gram: np.ndarray, n: float, epsilon: float, percentage: float) -> int:
    """Directions, from the least to the most varied, that nearly vanish on enough rows."""
    u = np.linalg.svd(gram)[0]
    hits = weighted_totals(vectors, len(gram), lambda x, w: w @ (np.abs(x @ u) < epsilon))
    enough = (hits / n >= percentage)[::-1]
    return len(gram) if enough.all() else int(np.argmin(enough))


def _scaled(theta: np.ndarray, scale: int) -> np.ndarray:
    """Rows of directions as integers, the smallest entry of each (the first such) as ``scale``; zero where one vanishes."""
    size = np.abs(theta)
    smallest = size.argmin(axis=1)
    row = np.arange(len(theta))
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.round(theta * (scale / theta[row, smallest])[:, None])
    scaled[row, smallest] = scale
    scaled[(size < ZERO_WEIGHT).any(axis=1)] = 0.0
    return scaled


def _directions(gram: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Least-variance direction of each row of column numbers."""
    return np.linalg.svd(gram[sets[:, :, None], sets[:, None, :]])[0][:, :, -1]


def integer_weights(gram: np.ndarray, cols: Columns, scale: int) -> np.ndarray | None:
    """Least-variance direction of the columns, scaled so its smallest entry is ``scale``."""
    scaled = _scaled(_directions(gram, np.array([cols])), scale)[0]
    return None if np.any(scaled == 0) else scaled


@dataclass
class Moments:
    """Of the columns of all rows: number of rows, second moments, rows where two are non-zero, largest size."""

    n: float
    gram: np.ndarray
    together: np.ndarray
    largest: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, size: int) -> Moments:
        n = vectors.agg(F.sum("weight").alias("n")).first()["n"]
        flags = vectors.withColumn("features", F.transform("features", lambda x: (x != 0).cast("double")))
        largest = np.zeros(size)
        rows = vectors.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.max(F.abs("x")).alias("m"))
        for r in rows.collect():
            largest[r["i"]] = r["m"]
        return cls(n, gram_matrix(vectors, size), gram_matrix(flags, size), largest)

    def least_misfits(self, sets: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A lower bound of the rows that break each set.

        A row adds at most the square of the largest possible sum to the second moment of the sums, and a
        row with exactly one non-zero column of the set always breaks it.
        """
        blocks = self.gram[sets[:, :, None], sets[:, None, :]]
        moment = np.einsum("ci,cij,cj->c", weights, blocks, weights)
        most = (np.abs(weights) * self.largest[sets]).sum(axis=1) ** 2
        by_moment = (moment - self.n * ZERO_FIT**2) / np.maximum(most, ZERO_FIT)
        pairs = self.together[sets[:, :, None], sets[:, None, :]]
        own = np.einsum("cii->c", pairs)
        alone = own - (pairs.sum(axis=(1, 2)) - own)
        return np.maximum(by_moment, alone)


def _tries(candidates: DataFrame, moments: Moments, allowed: float) -> DataFrame:
    """``items, scale, weights`` of the sets that may hold on all but ``allowed`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sets = np.vstack(batch["items"].to_numpy())
            theta = _directions(moments.gram, sets)
            for scale in SCALES:
                weights = _scaled(theta, scale)
                keep = (weights != 0).all(axis=1)
                keep[keep] = moments.least_misfits(sets[keep], weights[keep]) <= allowed + 1e-6 * moments.n
                if keep.any():
                    yield pd.DataFrame({"items": list(sets[keep]), "scale": scale, "weights": list(weights[keep])})

    return candidates.mapInPandas(run, "items array<int>, scale int, weights array<double>")


def holding(
    vectors: DataFrame, candidates: DataFrame, moments: Moments, percentage: float, stripe_bytes: int = STRIPE_BYTES
) -> DataFrame:
    """``items, weights``: the sets (``items``, equally long) that hold on enough rows, with the first scale that does."""
    size = len(moments.gram)
    tries = stage(_tries(candidates, moments, moments.n * (1 - percentage)), "tries")
    columns = max(1, -(-tries.count() * size * 8 // stripe_bytes))
    rows = max(1, -(-vectors.count() // STRIPE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (
        vectors.select("features", "weight")
        .withColumn("row", F.pmod(F.xxhash64("features"), F.lit(rows)).cast("int"))
        .withColumn("col", every(columns))
    )
    right = tries.withColumn("col", F.pmod(F.xxhash64("items"), F.lit(columns)).cast("int")).withColumn("row", every(rows))

    def count(_, points: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        fits = np.zeros(len(sets))
        if len(points) and len(sets):
            matrix, weight = np.vstack(points["features"].to_numpy()), points["weight"].to_numpy(dtype=float)
            items, weights = np.vstack(sets["items"].to_numpy()), np.vstack(sets["weights"].to_numpy())
            step = max(1, stripe_bytes // (8 * max(matrix.shape)))
            for low in range(0, len(sets), step):
                some = items[low : low + step]
                table = np.zeros((matrix.shape[1], len(some)))
                np.put_along_axis(table, some.T, weights[low : low + step].T, axis=0)
                fits[low : low + step] = weight @ (np.abs(matrix @ table) < ZERO_FIT)
        return sets[["items", "scale", "weights"]].assign(fits=fits)

    counted = (
        left.groupBy("row", "col")
        .cogroup(right.groupBy("row", "col"))
        .applyInPandas(count, "items array<int>, scale int, weights array<double>, fits double")
    )
    enough = counted.groupBy("items", "scale", "weights").agg(F.sum("fits").alias("fits")).where(
        F.col("fits") >= percentage * moments.n
    )
    return enough.groupBy("items").agg(F.min_by("weights", "scale").alias("weights"))


def _sets(spark: SparkSession, sets: Iterable[Columns]) -> DataFrame:
    return spark.createDataFrame([([int(c) for c in s],) for s in sets], "items array<int>")


def validate(
    vectors: DataFrame, gram: np.ndarray, n: float, candidates: list[Columns], percentage: float, stripe_bytes: int = STRIPE_BYTES
) -> dict[Columns, list[float]]:
    """Of a given list: the sets that hold on at least ``percentage`` of the rows, with the first scale that does."""
    moments = Moments.of(vectors, len(gram))
    moments.gram, moments.n = gram, n
    good: dict[Columns, list[float]] = {}
    for length in sorted({len(c) for c in candidates}):
        some = _sets(vectors.sparkSession, [c for c in candidates if len(c) == length])
        for r in holding(vectors, some, moments, percentage, stripe_bytes).collect():
            good[tuple(r["items"])] = list(r["weights"])
    return good


def _next_sets(spark: SparkSession, failed: DataFrame | None, singles: list[int], length: int) -> DataFrame:
    """Sets of ``length`` columns all of whose parts are among ``failed`` (all pairs of ``singles`` for length 2)."""
    if length == 2:
        table = spark.createDataFrame([(i, c, singles[i + 1 :]) for i, c in enumerate(singles)], "i int, c int, later array<int>")
        return table.select("c", F.explode("later").alias("d")).select(F.array("c", "d").alias("items"))
    keyed = failed.select(F.slice("items", 1, length - 2).alias("prefix"), F.element_at("items", -1).alias("last"))
    other = keyed.withColumnRenamed("last", "further")
    joined = keyed.join(other, "prefix").where("further > last").select(
        F.concat("prefix", F.array("last", "further")).alias("items")
    )
    # The parts without the last or the one before it are the two that were joined.
    places = F.explode(F.sequence(F.lit(0), F.lit(length - 3))).alias("out")
    parts = joined.select("items", places).select(
        "items", F.filter("items", lambda _, i: i != F.col("out")).alias("part")
    )
    known = failed.select(F.col("items").alias("part"))
    return parts.join(known, "part").groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == length - 2).select("items")


@dataclass
class _Level:
    """The invariants found so far, and the sets of one length that need no test any more."""

    found: dict[Columns, list[float]]
    length: int
    closed: set[Columns] = field(default_factory=set)

    def take(self, cols: Columns, weights: list[float]) -> None:
        """Sets implied by this invariant together with an earlier one are closed.

        An earlier one is never part of this set, so what both imply is at least as long; only sets that
        are candidates now can be closed.
        """
        new = set(cols)
        for earlier in self.found:
            if len(new | set(earlier)) == self.length + 1:
                self.closed |= {tuple(sorted((new | set(earlier)) - {shared})) for shared in new & set(earlier)}
        self.found[cols] = weights
        self.closed.add(cols)


@dataclass
class InvariantModel:
    """``invariants``: column indexes to integer weights; a row breaks one if the sum is not 0."""

    invariants: dict[Columns, list[float]]
    dimension: int = 0

    @classmethod
    def fit(
        cls,
        vectors: DataFrame,
        size: int,
        percentage: float = 0.98,
        epsilon: float = 0.5,
        longest: int | None = None,
    ) -> InvariantModel:
        """Mine from ``features, weight`` with ``size`` columns.

        At most ``dimension`` invariants are taken; what they close is a few sets each, so both stay on
        the driver. Candidates and failed sets do not.
        """
        spark = vectors.sparkSession
        moments = Moments.of(vectors, size)
        wanted = space_dimension(vectors, moments.gram, moments.n, epsilon, percentage)
        singles = [c for c in range(size) if moments.gram[c, c] != 0]
        found: dict[Columns, list[float]] = {(c,): [1.0] for c in range(size) if moments.gram[c, c] == 0}
        failed, length = None, 2
        while len(singles) > 1 and not (longest and length > longest):
            joined = stage(_next_sets(spark, failed, singles, length), "candidates")
            if joined.isEmpty():
                break
            if len(found) >= wanted:
                # The search ends after the first test, whatever it gives.
                joined = joined.orderBy("items").limit(1)
            level = _Level(found, length)
            # Only sets that hold can be taken; they come in order, and the rest is not fetched.
            for r in holding(vectors, joined, moments, percentage).orderBy("items").toLocalIterator():
                if tuple(r["items"]) not in level.closed:
                    level.take(tuple(r["items"]), list(r["weights"]))
                    if len(found) >= wanted:
                        break
            if len(found) >= wanted:
                break
            failed = joined.join(F.broadcast(_sets(spark, level.closed)), "items", "left_anti") if level.closed else joined
            length += 1
        return cls(found, wanted)

    def predict(self, vectors: DataFrame) -> DataFrame:
        """Add ``pred``: 1 where any invariant is broken."""
        broken = F.lit(0.0)
        for cols, weights in self.invariants.items():
            terms = [F.get("features", F.lit(c)) * F.lit(float(w)) for c, w in zip(cols, weights, strict=True)]
            broken = broken + F.abs(sum(terms[1:], terms[0]))
        return vectors.withColumn("pred", (broken > ANOMALY_SUM).cast("int"))

    def write(self, path: str, spark: SparkSession) -> None:
        rows = [(i, list(map(int, cols)), [float(w) for w in weights], self.dimension) for i, (cols, weights) in enumerate(self.invariants.items())]
        table = spark.createDataFrame(rows, "place int, items array<int>, weights array<double>, dimension int")
        table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvariantModel:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["place"])
        return cls({tuple(r["items"]): list(r["weights"]) for r in rows}, rows[0]["dimension"] if rows else 0)
