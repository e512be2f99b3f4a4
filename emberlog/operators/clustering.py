"""Log clustering by cosine distance of count vectors: offline, online and nearest-cluster scoring.

Vectors may have any sign. Two vectors within ``max_dist`` must share a coordinate among the leading
ones of both (the part of a vector after its leading coordinates is too short to reach the similarity
alone), so they meet on that coordinate. Coordinates that few vectors have come first, so few meet on
crowded ones; those are cut into a grid of blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.components import components, joined_up
from emberlog.operators.features import distinct_vectors
from emberlog.operators.gram import vector_blocks
from emberlog.operators.order import rank_in_order
from emberlog.session import stage

# Added to the norm product, and below which a distance counts as 0.
NORM_GUARD = 1e-8
ZERO_DISTANCE = 1e-8

# Distances are compared to this many decimals: equal ones may differ in the last bits.
DIGITS = 12

BLOCK = 2048
# Vectors (clusters, in rounds) of one side of a cell when clusters are formed, and similarities held at once.
CELL = 8_192
HELD = 1 << 22
# Pairs of heads that a cell of a round should compare at most.
CELL_PAIRS = 1 << 24
# A component of close vectors with at most so many rows and close pairs is clustered in one task.
SOLVE_ROWS = 20_000
SOLVE_PAIRS = 4_000_000
# Distinct vectors that found the first clusters of a stream.
SEEDS = 5_000
# Vectors, or representatives, that one task of the nearest-representative grid holds.
STRIPE = 20_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    raw = 1.0 - (a @ b.T) / (norms + NORM_GUARD)
    return np.where(raw < ZERO_DISTANCE, 0.0, raw)


def paired_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each row of ``a`` to the same row of ``b``; the same for both orders."""
    norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    raw = 1.0 - np.einsum("ij,ij->i", a, b) / (norms + NORM_GUARD)
    return np.round(np.where(raw < ZERO_DISTANCE, 0.0, raw), DIGITS)


def units(features: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision: their products tell which distances have to be computed."""
    return (features / np.maximum(np.linalg.norm(features, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def slack(width: int) -> float:
    """How far a product of two ``units`` may be below the cosine, at most."""
    return 1e-5 + 2e-7 * width


def number_vectors(vectors: DataFrame) -> DataFrame:
    """``id, features, weight`` of distinct vectors, numbered in hash order."""
    keyed = vectors.withColumn("_key", F.md5(F.array_join(F.col("features").cast("array<string>"), ",")))
    bucket = F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")
    return rank_in_order(keyed, bucket, ["_key"], out="id").drop("_key")


def rare_first(vectors: DataFrame) -> np.ndarray:
    """The coordinates by rising number of vectors that have them (a number per coordinate reaches the driver)."""
    counts = vectors.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(
        F.count_if(F.col("x") != 0).alias("n")
    )
    return np.array([r["i"] for r in sorted(counts.collect(), key=lambda r: (r["n"], r["i"]))], dtype=np.int64)


def leading_coordinates(features: np.ndarray, similarity: float, order: np.ndarray | None = None) -> np.ndarray:
    """Which coordinates of each row are non-zero and not in the tail (in ``order``) that is shorter than ``similarity``."""
    order = np.arange(features.shape[1]) if order is None else order
    unit = features[:, order] / np.maximum(np.linalg.norm(features, axis=1, keepdims=True), 1e-300)
    # Length of the tail that starts at each coordinate.
    tails = np.sqrt(np.cumsum((unit**2)[:, ::-1], axis=1)[:, ::-1])
    return (unit != 0) & (tails >= similarity - 1e-9)


def _leading(rows: DataFrame, max_dist: float, order: np.ndarray) -> DataFrame:
    """``key, coord`` of the leading coordinates of each row (``key, features``); ``coord`` is a place in ``order``."""
    if not 0 <= max_dist < 1:
        raise ValueError("max_dist must lie in [0, 1)")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, matrix in vector_blocks(batches):
            row, coord = np.nonzero(leading_coordinates(matrix, 1.0 - max_dist, order))
            yield pd.DataFrame({"key": batch["key"].to_numpy()[row], "coord": coord})

    return rows.mapInPandas(spread, "key bigint, coord bigint")


def _cells(rows: DataFrame, max_dist: float, order: np.ndarray, block: int) -> DataFrame:
    """``key, coord, own, row, col``: the grid cells in which each row (``key, features``) meets others.

    The rows of a coordinate are cut into stripes, and cell (row, col) holds two of them.
    """
    placed = _leading(rows, max_dist, order)
    # One row per coordinate: how many stripes its vectors are cut into.
    stripes = placed.groupBy("coord").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("stripes"))
    own = F.pmod(F.hash("key"), F.col("stripes"))
    other = F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("other")
    return (
        placed.join(stripes, "coord")
        .select("key", "coord", own.alias("own"), other)
        .select("key", "coord", "own", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"))
    )


def _close(cell: pd.DataFrame, max_dist: float, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``a, b, d`` of the pairs of one cell that are close, some at a time; a pair of several coordinates is left to the first one."""
    coord, row, col = (int(cell[c].iloc[0]) for c in ("coord", "row", "col"))
    left, right = cell[cell["own"] == row], cell[cell["own"] == col]
    if not len(left) or not len(right):
        return
    x, y = left["key"].to_numpy(), right["key"].to_numpy()
    a, b = np.vstack(left["features"]), np.vstack(right["features"])
    # Only the coordinates before this one decide whether the pair was met there.
    before = slice(0, coord)
    lead_a = np.packbits(leading_coordinates(a, 1.0 - max_dist, order)[:, before], axis=1)
    lead_b = np.packbits(leading_coordinates(b, 1.0 - max_dist, order)[:, before], axis=1)
    unit_a, unit_b = units(a), units(b)
    # The guard only makes distances larger, so no close pair is below this.
    least = 1.0 - max_dist - slack(a.shape[1])
    step = max(1, HELD // len(b))
    for low in range(0, len(x), step):
        i, j = np.nonzero(unit_a[low : low + step] @ unit_b.T >= least)
        i += low
        keep = x[i] < y[j] if row == col else x[i] != y[j]
        i, j = i[keep], j[keep]
        for start in range(0, len(i), 1 << 18):
            p, q = i[start : start + (1 << 18)], j[start : start + (1 << 18)]
            new = ~(lead_a[p] & lead_b[q]).any(axis=1)
            p, q = p[new], q[new]
            d = paired_distances(a[p], b[q])
            near = d <= max_dist
            p, q = x[p[near]], y[q[near]]
            yield np.minimum(p, q), np.maximum(p, q), d[near]


def _by_cell(cells: DataFrame, rows: int, block: int):
    """Rows grouped by cell. They are few and the work on them is not, so they are not left to be coalesced."""
    tasks = 4 * max(cells.sparkSession.sparkContext.defaultParallelism, -(-rows // block))
    return cells.repartition(tasks, "coord", "row", "col").groupBy("coord", "row", "col")


def _meeting(numbered: DataFrame, max_dist: float, block: int):
    """The rows of all cells with their features, grouped by cell, and the order of coordinates."""
    rows = numbered.select(F.col("id").alias("key"), "features")
    order = rare_first(rows)
    return _by_cell(_cells(rows, max_dist, order, block).join(rows, "key"), rows.count(), block), order


def close_pairs(numbered: DataFrame, max_dist: float, block: int = BLOCK) -> DataFrame:
    """``a, b, d`` (``a < b``) for all pairs of vectors within ``max_dist`` (below 1)."""
    cells, order = _meeting(numbered, max_dist, block)

    def pairs(cell: pd.DataFrame) -> pd.DataFrame:
        none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        a, b, d = (np.concatenate(part) for part in zip(none, *_close(cell, max_dist, order), strict=True))
        return pd.DataFrame({"a": a, "b": b, "d": d})

    return cells.applyInPandas(pairs, "a bigint, b bigint, d double")


def close_links(numbered: DataFrame, max_dist: float, block: int = CELL) -> DataFrame:
    """``a, b, pairs``: stars that connect what close pairs connect, and how many pairs they stand for.

    A cell returns at most a row per vector, however many of its vectors are close to each other.
    """
    cells, order = _meeting(numbered, max_dist, block)

    def stars(cell: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(cell["key"].to_numpy())
        every = np.arange(len(names))
        centre, pairs, met = every, np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=bool)
        for a, b, _ in _close(cell, max_dist, order):
            left, right = np.searchsorted(names, a), np.searchsorted(names, b)
            centre = joined_up(len(names), np.concatenate([every, left]), np.concatenate([centre, right]))
            pairs += np.bincount(left, minlength=len(names))
            met[left] = met[right] = True
        return pd.DataFrame({"a": names[centre[met]], "b": names[met], "pairs": pairs[met]})

    return cells.applyInPandas(stars, "a bigint, b bigint, pairs bigint")


def merged(points: np.ndarray, max_dist: float) -> np.ndarray:
    """Complete linkage of a few thousand vectors by nearest-neighbour chains: the first member of each one's cluster.

    Only distances within ``max_dist`` are kept. A merged cluster keeps those to clusters that both parts
    were close to; clusters that are each other's nearest stay so whatever else merges.
    """
    n = len(points)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for low in range(0, n, 512):
        d = distances(points[low : low + 512], points[low:])
        i, j = np.nonzero(d <= max_dist + 1e-9)
        d = np.round(d[i, j], DIGITS)
        keep = (i < j) & (d <= max_dist)
        for a, b, far in zip((low + i[keep]).tolist(), (low + j[keep]).tolist(), d[keep].tolist(), strict=True):
            near[a][b] = near[b][a] = far
    into = list(range(n))

    def nearest_of(c: int) -> int:
        around = near[c]
        least = min(around.values())
        return min(j for j, d in around.items() if d == least)

    for start in range(n):
        chain = [start]
        while chain:
            c = chain[-1]
            if into[c] != c or not near[c]:
                chain.pop()
                continue
            other = nearest_of(c)
            if len(chain) > 1 and chain[-2] == other:
                del chain[-2:]
                a, b = min(c, other), max(c, other)
                mine, theirs = near[a], near[b]
                both = {x: max(d, theirs[x]) for x, d in mine.items() if x in theirs}
                for x in mine:
                    if x in both:
                        near[x][a] = both[x]
                    elif x != b:
                        del near[x][a]
                for x in theirs:
                    if x != a:
                        del near[x][b]
                near[a], near[b], into[b] = both, {}, a
                if not chain and into[start] == start:
                    chain.append(start)
            else:
                chain.append(other)
    out = np.arange(n)
    for i in range(n):  # a cluster's name is below its members'
        out[i] = out[into[i]] if into[i] != i else i
    return out


def _solved(max_dist: float):
    """Clusters of whole components; rows are sorted by component and id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            rows = pd.concat(held)
            ids = rows["id"].to_numpy()
            return pd.DataFrame({"id": ids, "cluster": ids[merged(np.vstack(rows["features"]), max_dist)]})

        for batch in batches:
            for _, part in batch.groupby("component", sort=True):
                if held and held[0]["component"].iloc[0] != part["component"].iloc[0]:
                    yield done()
                    held = []
                held.append(part)
        if held:
            yield done()

    return run


def _facing_cells(heads: DataFrame, max_dist: float, order: np.ndarray, block: int) -> DataFrame:
    """``key, coord, row, col, asks``: grid cells in which the heads that ask meet all heads of their coordinates.

    The stripes of the heads that ask are the rows, those of all heads the columns of the grid.
    """
    asking = heads.select("key", "dirty")
    placed = _leading(heads.select("key", "features"), max_dist, order).join(asking, "key")
    # One row per coordinate: how many stripes its heads are cut into.
    size = lambda n, most: F.ceil(n / F.lit(most)).cast("int")
    counts = placed.groupBy("coord").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dirty")).alias("asks"))
    stripes = counts.where("asks > 0").select(
        "coord",
        size(F.col("n"), block).alias("cols"),
        size(F.col("asks") * F.least("n", F.lit(block)), min(block * block, CELL_PAIRS)).alias("rows"),
    )
    placed = placed.join(stripes, "coord")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.hash("key"), F.col(n))
    left = placed.where("dirty").select("key", "coord", own("rows").alias("row"), every("cols").alias("col"), F.lit(True).alias("asks"))
    right = placed.select("key", "coord", every("rows").alias("row"), own("cols").alias("col"), F.lit(False).alias("asks"))
    return left.unionByName(right)


def _farthest(a, b, first_a, size_a, first_b, size_b, p, q) -> np.ndarray:
    """The complete-linkage distance of each pair of clusters ``p`` (rows of ``a``) and ``q`` (rows of ``b``)."""
    out = np.empty(len(p))
    many = size_a[p] * size_b[q]
    ends = np.cumsum(many)
    low = 0
    while low < len(p):  # some whole pairs of clusters at a time
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - many[low] + (1 << 18), side="right")))
        starts = ends[low:high] - many[low:high] - (ends[low] - many[low])
        pair = np.repeat(np.arange(low, high), many[low:high])
        at = np.arange(len(pair)) - starts[pair - low]
        i, j = first_a[p[pair]] + at // size_b[q[pair]], first_b[q[pair]] + at % size_b[q[pair]]
        out[low:high] = np.maximum.reduceat(paired_distances(a[i], b[j]), starts)
        low = high
    return out


def _largest_first(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first rows and sizes of the clusters of sorted rows, largest first."""
    names, first, size = np.unique(side["key"].to_numpy(), return_index=True, return_counts=True)
    order = np.argsort(-size, kind="stable")
    return names[order], first[order], size[order]


def _layers(unit: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The first members of all clusters, the second ones of those that have any, and so on (largest first)."""
    for k in range(size[0]):
        n = int(np.searchsorted(-size, -k, side="left"))
        yield n, unit[first[:n] + k]


def _nearest_in_cell(cell: pd.DataFrame, max_dist: float) -> pd.DataFrame:
    """``cluster, d, other``: the nearest cluster (ties: lowest) of each cluster that asks, if it is close.

    Products in single precision leave few pairs of clusters; only their distances are computed.
    """
    none = pd.DataFrame({"cluster": [], "d": [], "other": []}).astype({"cluster": "int64", "other": "int64"})
    cell = cell.sort_values(["key", "id"])
    left, right = cell[cell["asks"]], cell[~cell["asks"]]
    if not len(left) or not len(right):
        return none
    (x, first_x, size_x), (y, first_y, size_y) = _largest_first(left), _largest_first(right)
    a, b = np.vstack(left["features"]), np.vstack(right["features"])
    unit_a = units(a)
    layers = list(_layers(units(b), first_y, size_y))
    shortest = np.linalg.norm(a, axis=1).min() * np.linalg.norm(b, axis=1).min()
    error = slack(a.shape[1])
    # The guard may make the distance of short vectors larger than their cosine tells.
    margin = 2 * error + NORM_GUARD / (shortest + NORM_GUARD)
    named = np.argsort(y)
    step, out = max(1, HELD // len(y)), [none]
    for low in range(0, len(x), step):
        names = x[low : low + step]
        s = np.full((len(names), len(y)), 2, dtype=np.float32)
        for m, mine in _layers(unit_a, first_x[low : low + step], size_x[low : low + step]):
            for n, theirs in layers:
                np.minimum(s[:m, :n], mine @ theirs.T, out=s[:m, :n])
        at = named[np.minimum(np.searchsorted(y, names, sorter=named), len(y) - 1)]
        same = np.flatnonzero(y[at] == names)
        s[same, at[same]] = -2
        p, q = np.nonzero(s >= np.maximum(s.max(axis=1) - margin, 1.0 - max_dist - error)[:, None])
        p += low
        d = _farthest(a, b, first_x, size_x, first_y, size_y, p, q)
        near = d <= max_dist
        p, d, other = p[near], d[near], y[q[near]]
        best = np.lexsort((other, d, p))
        p, d, other = p[best], d[best], other[best]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else best
        out.append(pd.DataFrame({"cluster": x[p[first]], "d": d[first], "other": other[first]}))
    return pd.concat(out)


def _merged_in_rounds(numbered: DataFrame, max_dist: float, block: int) -> DataFrame:
    """``id, cluster`` without a table of pairs: in every round clusters that are each other's nearest merge.

    All members of close clusters are close, so two of them meet where their first members meet. A cell
    keeps the nearest cluster of each of its clusters, a row per cluster. Distances only grow, so a cluster
    asks again only when it or its nearest one has merged, and one that is close to none is done.
    """
    order = rare_first(numbered)
    live = stage(numbered.select("id", F.col("id").alias("cluster"), "features", F.lit(True).alias("dirty")), "members")
    known: DataFrame | None = None
    done: list[DataFrame] = []
    while True:
        heads = live.where("id = cluster").select(F.col("id").alias("key"), "features", "dirty")
        cells = _facing_cells(heads, max_dist, order, block)
        cells = cells.join(live.select("id", F.col("cluster").alias("key"), "features"), "key")
        found = _by_cell(cells, live.count(), block).applyInPandas(
            lambda cell: _nearest_in_cell(cell, max_dist), "cluster bigint, d double, other bigint"
        )
        found = found.groupBy("cluster").agg(F.min(F.struct("d", "other")).alias("n")).select("cluster", "n.other")
        nearest_ = stage(found if known is None else found.unionByName(known), "nearest")
        pair = [F.least("cluster", "other").alias("into"), F.greatest("cluster", "other").alias("gone")]
        merges = stage(nearest_.select(*pair).groupBy("into", "gone").count().where("count = 2"), "merges")
        if merges.isEmpty():
            out = live.select("id", "cluster")
            for rows in done:
                out = out.unionByName(rows)
            return out
        changed = merges.select(F.explode(F.array("into", "gone")).alias("cluster"), "into")
        state = (
            nearest_.join(changed, "cluster", "left")
            .join(changed.select(F.col("cluster").alias("other"), F.lit(True).alias("_moved")), "other", "left")
            .select("cluster", "other", "into", (F.col("into").isNotNull() | F.col("_moved").isNotNull()).alias("dirty"))
        )
        known = state.where(~F.col("dirty")).select("cluster", "other")
        moved = live.drop("dirty").join(state.drop("other"), "cluster", "left")
        moved = stage(moved.select("id", F.coalesce("into", "cluster").alias("cluster"), "features", "dirty"), "members")
        live = moved.where("dirty is not null")
        done.append(moved.where("dirty is null").select("id", "cluster"))


def complete_linkage(
    numbered: DataFrame,
    max_dist: float,
    block: int = CELL,
    solve_rows: int = SOLVE_ROWS,
    solve_pairs: int = SOLVE_PAIRS,
) -> DataFrame:
    """``id, cluster``: complete-linkage clusters cut at ``max_dist``; ties go to the lower ids.

    Clusters never reach over a connected component of the close pairs. A component of bounded size is
    solved in one task, a larger one in rounds over the whole table; neither writes its pairs.
    """
    links = stage(close_links(numbered, max_dist, block), "links")
    found = stage(components(links), "components")
    pairs = links.join(found, F.col("b") == F.col("id")).groupBy("component").agg(F.sum("pairs").alias("pairs"))
    rows = found.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    fits = (F.col("rows") <= solve_rows) & (F.col("pairs") <= solve_pairs)
    sizes = rows.join(pairs, "component").select("component", fits.alias("fits"))
    placed = stage(numbered.select("id", "features").join(found.join(sizes, "component"), "id", "left"), "placed")
    small = placed.where("fits").repartition("component").sortWithinPartitions("component", "id")
    out = placed.where("component is null").select("id", F.col("id").alias("cluster"))
    out = out.unionByName(
        small.select("id", "component", "features").mapInPandas(_solved(max_dist), "id bigint, cluster bigint")
    )
    large = placed.where("not fits").select("id", "features")
    return out if large.isEmpty() else out.unionByName(_merged_in_rounds(large, max_dist, block))


def representatives(clustered: DataFrame) -> DataFrame:
    """``cluster, center, size`` from ``cluster, features, weight``: the weighted mean of each cluster."""
    slots = clustered.select("cluster", "weight", F.posexplode("features").alias("i", "x"))
    means = slots.groupBy("cluster", "i").agg(
        (F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("m"), F.sum("weight").alias("size")
    )
    packed = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("cluster").agg(
        F.transform(packed, lambda s: s["m"]).alias("center"), F.max("size").alias("size")
    )


def nearest(vectors: DataFrame, reps: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """Add ``distance`` and ``cluster`` of the nearest representative (ties: lowest cluster).

    Both sides are cut into stripes of bounded size. Every pair of stripes meets in one task of
    a grid, which keeps the best of its representatives for each vector; the best of all
    stripes is a partial aggregation. No representative passes through the driver.
    """
    distinct = vectors.select("features").distinct()
    columns = max(1, -(-reps.count() // stripe))
    rows = max(1, -(-distinct.count() // stripe))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = distinct.withColumn("row", F.pmod(F.xxhash64("features"), F.lit(rows)).cast("int")).withColumn("col", every(columns))
    right = reps.select("cluster", "center").withColumn(
        "col", F.pmod(F.xxhash64("cluster"), F.lit(columns)).cast("int")
    ).withColumn("row", every(rows))

    def compare(_, points: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        best = np.full(len(points), np.inf)
        who = np.full(len(points), -1, dtype=np.int64)
        if len(points) and len(centers):
            centers = centers.sort_values("cluster")
            names, middle = centers["cluster"].to_numpy(), np.vstack(centers["center"].to_numpy())
            for low in range(0, len(points), BLOCK):
                matrix = np.vstack(points["features"].to_numpy()[low : low + BLOCK])
                for start in range(0, len(names), BLOCK):
                    d = distances(matrix, middle[start : start + BLOCK])
                    at = d.argmin(axis=1)
                    value = d[np.arange(len(d)), at]
                    better = np.flatnonzero(value < best[low : low + BLOCK])
                    best[low + better], who[low + better] = value[better], names[start + at[better]]
        return pd.DataFrame({"features": points["features"], "distance": best, "cluster": who})

    found = (
        left.groupBy("row", "col")
        .cogroup(right.groupBy("row", "col"))
        .applyInPandas(compare, "features array<double>, distance double, cluster bigint")
    )
    best = found.groupBy("features").agg(F.min(F.struct("distance", "cluster")).alias("_best"))
    joined = vectors.join(best.select("features", "_best.*"), "features")
    return joined.select(*vectors.columns, "distance", "cluster")


@dataclass
class ClusterModel:
    """``reps``: ``cluster, center, size``."""

    reps: DataFrame
    anomaly_threshold: float = 0.3

    @classmethod
    def fit_offline(cls, vectors: DataFrame, max_dist: float = 0.3, anomaly_threshold: float = 0.3) -> ClusterModel:
        """``vectors``: ``features`` (one row per session, or distinct with ``weight``)."""
        numbered = stage(number_vectors(_weighted(vectors)), "numbered")
        clustered = numbered.join(complete_linkage(numbered, max_dist), "id")
        return cls(stage(representatives(clustered), "representatives"), anomaly_threshold)

    @classmethod
    def fit_online(
        cls,
        sessions: DataFrame,
        max_dist: float = 0.3,
        anomaly_threshold: float = 0.3,
        num_bootstrap_samples: int = 1000,
    ) -> ClusterModel:
        """``sessions``: ``session_id, first_line, features``. Clusters the first sessions, lets
        the others join the nearest cluster within ``max_dist``, and clusters what is left."""
        first = sessions.orderBy("first_line", "session_id").limit(num_bootstrap_samples)
        start = stage(first.select("session_id", "features"), "bootstrap")
        model = cls.fit_offline(start.select("features"), max_dist, anomaly_threshold)
        rest = sessions.join(start.select("session_id"), "session_id", "left_anti")
        return model.extended(rest.select("features"), max_dist)

    @classmethod
    def fit_seeded(
        cls, vectors: DataFrame, max_dist: float = 0.3, anomaly_threshold: float = 0.3, seeds: int = SEEDS
    ) -> ClusterModel:
        """Clusters of a bounded number of distinct vectors (by hash); the others join, or found more in blocks."""
        numbered = stage(number_vectors(_weighted(vectors)), "numbered")
        model = cls.fit_offline(numbered.where(F.col("id") < seeds).drop("id"), max_dist, anomaly_threshold)
        return model.extended(numbered.where(F.col("id") >= seeds).drop("id"), max_dist, seeds)

    def extended(self, vectors: DataFrame, max_dist: float, block: int | None = None) -> ClusterModel:
        """The model after more vectors: running means move, and new clusters are added.

        With ``block`` at most so many of the vectors that fit no cluster are clustered at once; the
        rest of them may join the clusters that this founds, and so on.
        """
        placed = stage(nearest(_weighted(vectors), self.reps), "placed")
        joined = placed.where(F.col("distance") <= max_dist).select("cluster", "features", "weight")
        old = self.reps.select("cluster", F.col("center").alias("features"), F.col("size").alias("weight"))
        moved = representatives(old.unionByName(joined))
        unplaced = placed.where(F.col("distance") > max_dist).select("features", "weight")
        if unplaced.isEmpty():
            return ClusterModel(stage(moved, "representatives"), self.anomaly_threshold)
        if block is None:
            new = ClusterModel.fit_offline(unplaced, max_dist).reps
        else:
            new = ClusterModel.fit_seeded(unplaced, max_dist, seeds=block).reps
        next_name = (self.reps.agg(F.max("cluster").alias("m")).first()["m"] or 0) + 1
        renamed = new.withColumn("cluster", F.col("cluster") + F.lit(next_name))
        return ClusterModel(stage(moved.unionByName(renamed), "representatives"), self.anomaly_threshold)

    def write(self, path: str) -> ClusterModel:
        spark = self.reps.sparkSession
        self.reps.write.mode("overwrite").parquet(f"{path}/representatives")
        limit = spark.createDataFrame([(float(self.anomaly_threshold),)], "anomaly_threshold double")
        limit.write.mode("overwrite").parquet(f"{path}/threshold")
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClusterModel:
        limit = spark.read.parquet(f"{path}/threshold").first()["anomaly_threshold"]
        return cls(spark.read.parquet(f"{path}/representatives"), limit)

    def predict(self, vectors: DataFrame) -> DataFrame:
        """Add ``distance, cluster, pred``: 1 where even the nearest cluster is too far."""
        far = F.col("distance") > self.anomaly_threshold
        return nearest(vectors, self.reps).withColumn("pred", far.cast("int"))


def _weighted(vectors: DataFrame) -> DataFrame:
    if "weight" not in vectors.columns:
        return distinct_vectors(vectors)
    return vectors.groupBy("features").agg(F.sum("weight").alias("weight"))
