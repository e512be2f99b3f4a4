"""Session labels from n-gram presence: logistic regression whose weights are a table.

No vocabulary and no weight vector passes the driver. The loss is the mean log loss plus an L2 penalty on
the weights (not on the offset). It is minimised by L-BFGS in its vector-free form: the weights, their
gradient and the last few steps are columns of one table with a row per gram; all their dot products come
from one aggregate, and the direction is a combination of those columns. A margin moves linearly along a
direction, so one aggregate gives the loss at all step lengths that are tried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import SMALL_ROWS, stage

MEMORY = 5
STEPS = (4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-4)


def _log_loss(margin: Column, label: Column) -> Column:
    """log(1 + exp(-s z)) with s = 1 or -1, without overflow."""
    z = F.when(label > 0, margin).otherwise(-margin)
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def _direction(dots: np.ndarray, pairs: int) -> np.ndarray:
    """L-BFGS coefficients of (steps, gradient changes, gradient) from their dot products, newest pair last."""
    c = np.zeros(2 * pairs + 1)
    c[-1] = -1.0
    alphas = np.zeros(pairs)
    useful = [i for i in range(pairs) if dots[i, pairs + i] > 0]
    for i in reversed(useful):
        alphas[i] = dots[i] @ c / dots[i, pairs + i]
        c[pairs + i] -= alphas[i]
    if useful:
        last = useful[-1]
        c *= dots[last, pairs + last] / dots[pairs + last, pairs + last]
    for i in useful:
        beta = dots[pairs + i] @ c / dots[i, pairs + i]
        c[i] += alphas[i] - beta
    return c


@dataclass
class GramClassifier:
    """``weights``: ``gram, weight``; a session is positive where their sum and ``bias`` exceed 0.

    ``rounds`` and ``slope`` tell how the fit ended: iterations, and the largest entry of the gradient.
    """

    weights: DataFrame
    bias: float = 0.0
    broadcast_rows: int = SMALL_ROWS
    rounds: int = 0
    slope: float = 0.0

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        reg_param: float = 0.01,
        max_iter: int = 20,
        tol: float = 1e-4,
        broadcast_rows: int = SMALL_ROWS,
    ) -> GramClassifier:
        """``train``: ``grams, label``. Ends when no entry of the gradient is above ``tol``."""
        once = train.groupBy("grams", (F.col("label") > 0).cast("int").alias("label")).agg(
            F.count(F.lit(1)).cast("double").alias("n")
        )
        rows = stage(once.withColumn("row", F.monotonically_increasing_id()), "gram-rows")
        entries = stage(rows.select("row", F.explode(F.array_distinct("grams")).alias("gram")), "gram-entries")
        total = rows.agg(F.sum("n").alias("n")).first()["n"]
        if not total:
            raise ValueError("no sessions to train on")
        state = entries.select("gram").distinct().withColumns({"w": F.lit(0.0), "g": F.lit(0.0)})
        few = state.limit(broadcast_rows + 1).count() <= broadcast_rows
        at = rows.select("row", "label", "n", F.lit(0.0).alias("z"))
        bias, names, bias_of = 0.0, [], {}

        def small(table: DataFrame) -> DataFrame:
            return F.broadcast(table) if few else table

        def with_gradient(state: DataFrame, at: DataFrame, columns: list[Column]) -> tuple[DataFrame, float]:
            """The state with the gradient at the rows' margins, and the slope of the offset."""
            error = (F.lit(1.0) / (1.0 + F.exp(-F.col("z"))) - F.col("label")) * F.col("n") / total
            missed = at.select("row", error.alias("r"))
            sums = entries.join(missed, "row").groupBy("gram").agg(F.sum("r").alias("r"))
            slope = missed.agg(F.sum("r").alias("r")).first()["r"]
            return state.join(sums, "gram", "left").select("gram", *columns), slope

        state, bias_of["g"] = with_gradient(state, at, ["w", F.col("r").alias("g")])
        state = stage(state, "gram-state")
        done, slope = 0, 0.0
        for done in range(max_iter + 1):
            basis = [*[f"s{i}" for i in names], *[f"y{i}" for i in names], "g"]
            pairs = [(a, b) for i, a in enumerate(basis) for b in basis[i:]]
            found = state.agg(
                F.max(F.abs("g")).alias("slope"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]
            ).first()
            slope = max(found["slope"] or 0.0, abs(bias_of["g"]))
            if slope <= tol or done == max_iter:
                break
            dots = np.zeros((len(basis), len(basis)))
            for a, b in pairs:
                i, j = basis.index(a), basis.index(b)
                dots[i, j] = dots[j, i] = (found[f"{a}_{b}"] or 0.0) + bias_of[a] * bias_of[b]
            c = _direction(dots, len(names))
            towards = sum((F.lit(float(x)) * F.col(b) for x, b in zip(c, basis, strict=True)), F.lit(0.0))
            bias_towards = float(sum(x * bias_of[b] for x, b in zip(c, basis, strict=True)))
            moved = entries.join(small(state.select("gram", towards.alias("d"))), "gram").groupBy("row").agg(F.sum("d").alias("d"))
            dz = F.coalesce("d", F.lit(0.0)) + F.lit(bias_towards)
            at = stage(at.join(moved, "row", "left").select("row", "label", "n", "z", dz.alias("dz")), "gram-margins")
            sizes = state.agg(
                F.sum(F.col("w") * F.col("w")).alias("ww"),
                F.sum(F.col("w") * towards).alias("wd"),
                F.sum(towards * towards).alias("dd"),
            ).first()
            losses = at.agg(
                *[
                    (F.sum(F.col("n") * _log_loss(F.col("z") + t * F.col("dz"), F.col("label"))) / total).alias(f"t{k}")
                    for k, t in enumerate((0.0, *STEPS))
                ]
            ).first()
            ridge = [
                0.5 * reg_param * ((sizes["ww"] or 0.0) + 2 * t * (sizes["wd"] or 0.0) + t * t * (sizes["dd"] or 0.0))
                for t in (0.0, *STEPS)
            ]
            values = [losses[f"t{k}"] + r for k, r in enumerate(ridge)]
            best = int(np.argmin(values))
            if best == 0:
                break
            step = STEPS[best - 1]
            at = at.select("row", "label", "n", (F.col("z") + step * F.col("dz")).alias("z"))
            name = done
            kept = names[-(MEMORY - 1) :]
            new_w = F.col("w") + step * towards
            new_g = F.col("r") + reg_param * new_w
            columns = [
                new_w.alias("w"),
                new_g.alias("g"),
                *[F.col(f"{k}{i}") for i in kept for k in "sy"],
                (step * towards).alias(f"s{name}"),
                (new_g - F.col("g")).alias(f"y{name}"),
            ]
            before = bias_of["g"]
            state, bias_of["g"] = with_gradient(state, at, columns)
            state = stage(state, "gram-state")
            bias += step * bias_towards
            bias_of[f"s{name}"], bias_of[f"y{name}"] = step * bias_towards, bias_of["g"] - before
            names = [*kept, name]
        return cls(state.select("gram", F.col("w").alias("weight")), bias, broadcast_rows, done, slope)

    def write(self, path: str) -> GramClassifier:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        bias = self.weights.sparkSession.createDataFrame([(float(self.bias),)], "bias double")
        bias.write.mode("overwrite").parquet(f"{path}/bias")
        return self.load(self.weights.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GramClassifier:
        return cls(spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/bias").first()["bias"])

    def margin(self, sequences: DataFrame) -> DataFrame:
        """Add ``margin``. Each distinct list of grams is scored once; unknown grams weigh nothing."""
        few = self.weights.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows
        weights = F.broadcast(self.weights) if few else self.weights
        once = sequences.select("grams").distinct()
        long = once.select("grams", F.explode(F.array_distinct("grams")).alias("gram")).join(weights, "gram")
        sums = long.groupBy("grams").agg(F.sum("weight").alias("_sum"))
        margin = (F.coalesce("_sum", F.lit(0.0)) + F.lit(float(self.bias))).alias("margin")
        return sequences.join(sums, "grams", "left").select(*sequences.columns, margin)

    def predict(self, sequences: DataFrame) -> DataFrame:
        """Add ``pred``."""
        out = self.margin(sequences)
        return out.select(*sequences.columns, (F.col("margin") > 0).cast("int").alias("pred"))
