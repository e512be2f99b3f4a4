"""Rounds of complete linkage: the nearest cluster is exact, and only clusters near a merge ask again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.operators import clustering


def members(rng, points, clusters, asks):
    """The rows of a cell: ``points`` in ``clusters``, named by their least id; some ask."""
    part = rng.integers(0, clusters, len(points))
    names = {c: int(np.flatnonzero(part == c)[0]) for c in set(part.tolist())}
    rows = pd.DataFrame({"id": range(len(points)), "key": [names[c] for c in part.tolist()], "features": list(points)})
    asking = rows[rows["key"].isin(asks(sorted(names.values())))]
    return pd.concat([asking.assign(asks=True), rows.assign(asks=False)])


@pytest.mark.parametrize("scale", [1.0, 1e-4])
def test_nearest_cluster_of_a_cell_equals_all_pairs(scale, monkeypatch):
    """With equal distances, clusters of several sizes and vectors so short that the guard counts."""
    monkeypatch.setattr(clustering, "HELD", 64)
    rng = np.random.default_rng(2)
    points = rng.integers(0, 4, (70, 4)) * scale
    points = points[points.any(axis=1)]
    points[::7] *= 3
    cell = members(rng, points, 40, lambda names: names[::2])
    got = {r.cluster: (r.d, r.other) for r in clustering._nearest_in_cell(cell, 0.2).itertuples()}
    groups = cell[~cell["asks"]].groupby("key")["features"].apply(np.vstack).to_dict()
    want = {}
    for one in set(cell[cell["asks"]]["key"]):
        far = {
            other: float(np.round(clustering.distances(groups[one], groups[other]), clustering.DIGITS).max())
            for other in groups
            if other != one
        }
        d, other = min((d, other) for other, d in far.items())
        if d <= 0.2:
            want[one] = (pytest.approx(d, abs=1e-11), other)
    assert got == want and len(want) > 5


def test_only_clusters_near_a_merge_ask_again(spark, monkeypatch):
    """Pairs far from all others are done after the round that follows their merge."""
    asked, cells = [], clustering._facing_cells

    def counted(heads, *others):
        asked.append((heads.count(), heads.where("dirty").count()))
        return cells(heads, *others)

    monkeypatch.setattr(clustering, "_facing_cells", counted)
    rng = np.random.default_rng(6)
    pairs = np.zeros((60, 36))
    for i in range(30):
        pairs[2 * i, i], pairs[2 * i + 1, i], pairs[2 * i + 1, (i + 1) % 30] = 1, 1, 0.1
    crowd = np.zeros((60, 36))
    crowd[:, 30:] = rng.integers(0, 9, (60, 6))
    points = np.unique(np.vstack([pairs, crowd]), axis=0)
    numbered = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, features array<double>")
    got = clustering.complete_linkage(numbered, 0.1, solve_rows=0, solve_pairs=0).groupBy("cluster").agg(F.count("id").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == len(points)
    assert asked[0][0] == asked[0][1]
    assert len(asked) > 3 and all(heads <= asked[0][0] - 60 for heads, _ in asked[2:])
    assert all(again < heads for heads, again in asked[2:-1]) and asked[-1][1] < 20


def test_a_dense_cell_folds_its_pairs(spark):
    """Stars of 600 vectors that are all close, compared in several portions: a row per vector."""
    points = 10 + np.random.default_rng(8).random((600, 3))
    cell = pd.DataFrame({"key": range(600), "features": list(points), "coord": 0, "own": 0, "row": 0, "col": 0})
    parts = list(clustering._close(cell, 0.2, np.arange(3)))
    assert sum(len(a) for a, _, _ in parts) == 600 * 599 // 2
    numbered = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, features array<double>")
    links = clustering.close_links(numbered, 0.2)
    row = links.agg(F.count("b").alias("n"), F.sum("pairs").alias("pairs"), F.count_distinct("a").alias("centres")).first()
    assert row["pairs"] == 600 * 599 // 2 and row["n"] == 600 and row["centres"] == 1
