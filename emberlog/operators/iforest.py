"""Isolation forest: per-tree samples by hash, trees grown in parallel, scoring on distinct vectors.

Every row draws a hash per tree, and a tree is grown from the rows with the least hashes. Only rows below
a bound that leaves a few more than wanted leave the scan; their exact ranks are taken bucket by bucket.
A tree whose sample is larger than ``TASK_ROWS`` is split level by level over the whole cluster until its
parts fit a task. Nodes are numbered like a heap: the root is 1, the children of i are 2 i and 2 i + 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.gram import vector_blocks, widened
from emberlog.operators.order import rank_in_order, running_sums
from emberlog.session import SMALL_ROWS, stage

AUTO_SAMPLE = 256
AUTO_THRESHOLD = 0.5
EULER_GAMMA = float(np.euler_gamma)
NODES = "tree int, node bigint, feature int, cut double, depth double"
# Rows that one task grows a tree from.
TASK_ROWS = 100_000
# Vectors, and nodes, that one task of the scoring grid holds.
STRIPE = 50_000
BLOCK_NODES = 1_000_000


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    many = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER_GAMMA) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def grow_tree(
    points: np.ndarray, tree: int, seed: int, columns: np.ndarray, limit: int, root: int = 1
) -> pd.DataFrame:
    """Node table of one tree (or its part below ``root``) over a bounded sample.

    A leaf stores its depth plus the expected rest; ``limit`` is the largest depth.
    """
    rng = np.random.default_rng([seed, tree, root])
    rows: list[tuple] = []
    todo = [(np.arange(len(points)), root)]
    while todo:
        at, node = todo.pop()
        depth = node.bit_length() - 1
        low, high = points[at].min(axis=0), points[at].max(axis=0)
        usable = columns[high[columns] > low[columns]]
        if depth >= limit or len(at) <= 1 or not usable.size:
            rows.append((tree, node, -1, 0.0, depth + float(average_path(len(at)))))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        rows.append((tree, node, feature, cut, 0.0))
        below = points[at, feature] <= cut
        todo.append((at[below], 2 * node))
        todo.append((at[~below], 2 * node + 1))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "depth"])


def _total_depth(matrix: np.ndarray, nodes: pd.DataFrame) -> np.ndarray:
    """Depth of each row summed over the trees of a node table."""
    total = np.zeros(len(matrix))
    every = np.arange(len(matrix))
    for _, tree in nodes.groupby("tree"):
        tree = tree.sort_values("node")
        names = tree["node"].to_numpy()
        feature, cut, depth = (tree[c].to_numpy() for c in ("feature", "cut", "depth"))
        low = np.searchsorted(names, np.where(feature >= 0, 2 * names, names))
        high = np.searchsorted(names, np.where(feature >= 0, 2 * names + 1, names))
        at = np.zeros(len(matrix), dtype=np.int64)
        while (feature[at] >= 0).any():
            below = matrix[every, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(below, low[at], high[at])
        total += depth[at]
    return total


def tree_columns(size: int, trees: int, max_features: int | float, seed: int) -> list[np.ndarray]:
    """The columns that each tree may cut."""
    use = int(max_features * size) if isinstance(max_features, float) else int(max_features)
    use = max(1, min(size, use))
    return [np.sort(np.random.default_rng([seed, t, 1]).choice(size, size=use, replace=False)) for t in range(trees)]


def _drawn(rows: DataFrame, trees: int, size: int, n: int, seed: int) -> DataFrame:
    """``tree, place, features``: the ``size`` rows with the least hashes of each tree, in their order."""
    spare = size + 6.0 * np.sqrt(size) + 10
    while True:
        share = min(1.0, spare / n)
        bound = F.lit(int(share * 2**62) if share < 1.0 else 2**63 - 1)
        draw = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col("session_id")), 2)
        # Which trees want a row is known before its vector is copied.
        wanted = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < bound)  # noqa: B023
        spread = rows.select("session_id", "features", F.explode(wanted).alias("tree"))
        picked = stage(spread.withColumn("draw", draw(F.col("tree"))), "forest-draws")
        if share == 1.0 or picked.groupBy("tree").count().where(F.col("count") >= size).count() == trees:
            break
        spare *= 2
    # Buckets of the hash that hold some thousand rows each, whatever the size of the sample.
    width = max(1, int(2**62 * share / max(1, spare // 4_096)))
    ranked = rank_in_order(picked, F.floor(F.col("draw") / F.lit(width)).cast("bigint"), ["draw", "session_id"], by=["tree"], out="place")
    return ranked.where(F.col("place") < size).select("tree", "place", "features")


def _resampled(picked: DataFrame, trees: int, size: int, seed: int) -> DataFrame:
    """As many rows drawn from each tree's sample with replacement."""
    spark = picked.sparkSession
    draws = spark.range(size).select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    place = F.pmod(F.xxhash64(F.lit(seed), F.lit("again"), "tree", "id"), F.lit(size)).alias("place")
    times = draws.select("tree", place).groupBy("tree", "place").agg(F.count(F.lit(1)).cast("int").alias("times"))
    again = picked.join(times, ["tree", "place"])
    return again.select("tree", "place", "features", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def _split_large(
    points: DataFrame, columns: DataFrame, limit: int, seed: int, task_rows: int
) -> tuple[DataFrame, list[DataFrame]]:
    """Cut parts above ``task_rows`` level by level: the points with their nodes, and the tables of nodes made."""
    points, made = stage(points.withColumn("node", F.lit(1).cast("bigint")), "forest-points"), []
    keys = ["tree", "node"]
    while True:
        counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_rows)
        large = stage(counts, "forest-large")
        if large.isEmpty():
            return points, made
        ranges = (
            points.join(F.broadcast(large) if large.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else large, keys)
            .select(*keys, "n", F.posexplode("features").alias("i", "x"))
            .groupBy(*keys, "n", "i")
            .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
            .join(F.broadcast(columns), ["tree", "i"])
        )
        open_ = F.sort_array(F.collect_list(F.when(F.col("hi") > F.col("lo"), F.struct("i", "lo", "hi")))).alias("open")
        depth = F.floor(F.log2(F.col("node")) + 1e-9)
        pick = F.try_element_at("open", (F.pmod(F.xxhash64(F.lit(seed), *keys), F.size("open")) + 1).cast("int"))
        chosen = F.when((depth < limit) & (F.size("open") > 0), pick)
        even = F.pmod(F.xxhash64(F.lit(seed), F.lit("cut"), *keys), F.lit(1 << 53)) / float(1 << 53)
        splits = stage(
            ranges.groupBy(*keys, "n").agg(open_).select(*keys, "n", chosen.alias("c"), depth.alias("depth")).select(
                "tree",
                "node",
                "n",
                "depth",
                F.coalesce(F.col("c.i"), F.lit(-1)).cast("int").alias("feature"),
                F.coalesce(F.col("c.lo") + even * (F.col("c.hi") - F.col("c.lo")), F.lit(0.0)).alias("cut"),
            ),
            "forest-splits",
        )
        many = F.col("n").cast("double")
        rest = 2.0 * (F.log(many - 1.0) + EULER_GAMMA) - 2.0 * (many - 1.0) / many
        leaf = F.col("feature") < 0
        made.append(splits.select(*keys, "feature", "cut", F.when(leaf, F.col("depth") + rest).otherwise(0.0).alias("depth")))
        few = splits.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
        cuts = splits.select(*keys, "feature", "cut")
        below = F.get("features", F.col("feature")) <= F.col("cut")
        node = F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(below, 0).otherwise(1))
        moved = points.join(F.broadcast(cuts) if few else cuts, keys, "left").where("feature is null or feature >= 0")
        points = stage(moved.select("tree", "place", "features", node.alias("node")), "forest-points")


def weighted_percentile(scores: DataFrame, value: str, share: float) -> float:
    """Exact percentile (linear between neighbours) of ``value`` counted ``weight`` times."""
    # Written once: the bounds, the total and the sums below would each score every row again.
    per_value = stage(scores.groupBy(F.col(value).alias("v")).agg(F.sum("weight").alias("w")), "scores")
    summed = running_sums(per_value, "v", ["w"])
    n = per_value.agg(F.sum("w").alias("n")).first()["n"]
    place = (n - 1) * share
    low, high = np.floor(place), np.ceil(place)
    row = summed.agg(
        F.min(F.when(F.col("cum_w") > low, F.col("v"))).alias("lo"),
        F.min(F.when(F.col("cum_w") > high, F.col("v"))).alias("hi"),
    ).first()
    return row["lo"] + (row["hi"] - row["lo"]) * (place - low)


@dataclass
class ForestModel:
    """``nodes``: ``tree, node, feature, cut, depth``; a leaf has feature -1."""

    nodes: DataFrame
    sample_size: int
    threshold: float | None = None
    small_nodes: int = SMALL_ROWS

    @classmethod
    def fit(
        cls,
        rows: DataFrame,
        n_estimators: int = 100,
        max_samples: int | float | str = "auto",
        contamination: float | str = 0.03,
        max_features: int | float = 1.0,
        bootstrap: bool = False,
        seed: int = 42,
        task_rows: int = TASK_ROWS,
    ) -> ForestModel:
        """``rows``: ``session_id, features``, one row per session.

        ``contamination="auto"`` flags scores above one half instead of a share of the rows.
        """
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit on")
        wanted = {"auto": min(AUTO_SAMPLE, n)}.get(max_samples) if isinstance(max_samples, str) else max_samples
        size = max(1, min(n, int(wanted * n) if isinstance(wanted, float) else int(wanted)))
        limit = int(np.ceil(np.log2(max(size, 2))))
        width = rows.select(F.size("features").alias("k")).first()["k"]
        columns = tree_columns(width, n_estimators, max_features, seed)
        spark = rows.sparkSession
        picked = _drawn(rows, n_estimators, size, n, seed)
        if bootstrap:
            picked = _resampled(picked, n_estimators, size, seed)
        made: list[DataFrame] = []
        if size > task_rows:
            allowed = [(t, int(i)) for t, mine in enumerate(columns) for i in mine]
            table = spark.createDataFrame(allowed, "tree int, i int")
            points, made = _split_large(picked, table, limit, seed, task_rows)
        else:
            points = picked.withColumn("node", F.lit(1).cast("bigint"))

        def build(part: pd.DataFrame) -> pd.DataFrame:
            matrix = np.vstack(part.sort_values("place")["features"].to_numpy())
            tree, node = int(part["tree"].iloc[0]), int(part["node"].iloc[0])
            return grow_tree(matrix, tree, seed, columns[tree], limit, node)

        # Little data but much work per row and tree: spread it over the cores, not by bytes.
        tasks = max(min(n_estimators, spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions")))
        nodes = points.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInPandas(build, NODES)
        for table in made:
            nodes = nodes.unionByName(table)
        model = cls(stage(nodes, "forest"), size)
        if contamination == "auto":
            model.threshold = AUTO_THRESHOLD
            return model
        weighted = rows.groupBy("features").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        model.threshold = weighted_percentile(model.score(weighted), "score", 1.0 - contamination)
        return model

    def write(self, path: str) -> ForestModel:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        facts = spark.createDataFrame([(int(self.sample_size), None if self.threshold is None else float(self.threshold))], "sample_size bigint, threshold double")
        facts.write.mode("overwrite").parquet(f"{path}/facts")
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        facts = spark.read.parquet(f"{path}/facts").first()
        return cls(spark.read.parquet(f"{path}/nodes"), facts["sample_size"], facts["threshold"])

    def score(self, vectors: DataFrame) -> DataFrame:
        """Add ``score`` in (0, 1): close to 1 for points that are isolated early.

        A small forest goes to the tasks as it is. Blocks of trees of a larger one meet stripes of
        distinct vectors in a grid, and the depths of all blocks are added up.
        """
        trees = self.nodes.select("tree").distinct().count()
        norm = max(float(average_path(self.sample_size)), 1e-12) * trees
        table = self.nodes.limit(self.small_nodes + 1).toPandas()
        if len(table) <= self.small_nodes:

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch, matrix in vector_blocks(batches):
                    yield batch.assign(score=2.0 ** (-_total_depth(matrix, table) / norm))

            return vectors.mapInPandas(run, widened(vectors, score="double"))
        per_tree = self.nodes.count() / trees
        blocks = int(np.ceil(trees / max(1, BLOCK_NODES // per_tree)))
        distinct = vectors.select("features").distinct()
        rows = max(1, -(-distinct.count() // STRIPE))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = distinct.withColumn("row", F.pmod(F.xxhash64("features"), F.lit(rows)).cast("int")).withColumn("col", every(blocks))
        right = self.nodes.withColumn("col", F.pmod("tree", F.lit(blocks)).cast("int")).withColumn("row", every(rows))

        def deep(_, points: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(points))
            if len(points) and len(nodes):
                total = _total_depth(np.vstack(points["features"].to_numpy()), nodes)
            return pd.DataFrame({"features": points["features"], "total": total})

        found = left.groupBy("row", "col").cogroup(right.groupBy("row", "col"))
        depths = found.applyInPandas(deep, "features array<double>, total double").groupBy("features").agg(F.sum("total").alias("_total"))
        score = F.pow(F.lit(2.0), -F.col("_total") / F.lit(norm)).alias("score")
        return vectors.join(depths, "features").select(*vectors.columns, score)

    def predict(self, vectors: DataFrame) -> DataFrame:
        """Add ``score, pred``: 1 strictly past the contamination threshold."""
        return self.score(vectors).withColumn("pred", (F.col("score") > self.threshold).cast("int"))
