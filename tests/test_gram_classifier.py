"""The n-gram classifier against a dense minimisation, with and without broadcasts."""

import random

import numpy as np
import pytest
from emberlog.operators.gram_classifier import GramClassifier

SCHEMA = "session_id bigint, grams array<string>, label int"


@pytest.fixture(scope="module")
def sessions():
    rng = random.Random(21)
    rows = []
    for i in range(160):
        grams = sorted({f"g{rng.randrange(30)}" for _ in range(rng.randint(0, 9))})
        signal = sum(int(g[1:]) % 3 - 1 for g in grams) + rng.gauss(0, 1)
        rows.append((i, grams, int(signal > 0.5)))
    return rows + [(900 + i, ["g1", "g2"], 1) for i in range(15)] + [(950, ["g1", "g2"], 0), (951, [], 1), (952, ["rare", "rare"], 0)]


def dense(rows, reg):
    """Weights and offset by plain gradient descent until the gradient vanishes."""
    names = sorted({g for _, grams, _ in rows for g in grams})
    x = np.array([[g in grams for g in names] for _, grams, _ in rows], dtype=float)
    y = np.array([label for *_, label in rows], dtype=float)
    w, b = np.zeros(len(names)), 0.0
    for _ in range(60_000):
        r = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w, b = w - 1.0 * (x.T @ r + reg * w), b - 1.0 * r.sum()
    return dict(zip(names, w)), b


@pytest.mark.parametrize("broadcast_rows", [10, 200_000])
def test_fit_reaches_the_minimum(spark, sessions, broadcast_rows, tmp_path):
    """Also with more grams than may be broadcast: then weights meet entries by shuffled joins only."""
    frame = spark.createDataFrame(sessions, SCHEMA).repartition(3)
    model = GramClassifier.fit(frame, reg_param=0.02, max_iter=40, tol=1e-5, broadcast_rows=broadcast_rows)
    assert model.slope <= 1e-5 and model.rounds < 40
    weights, bias = dense(sessions, 0.02)
    got = {r.gram: r.weight for r in model.weights.collect()}
    assert got.keys() == weights.keys()
    assert max(abs(got[g] - weights[g]) for g in got) < 2e-3 and abs(model.bias - bias) < 2e-3
    loaded = model.write(str(tmp_path / "model"))
    unseen = frame.union(spark.createDataFrame([(1_000, ["never", "g3"], 0)], SCHEMA))
    for r in loaded.margin(unseen).collect():
        assert r.margin == pytest.approx(bias + sum(weights.get(g, 0.0) for g in set(r.grams)), abs=2e-2)
    plan = model.margin(frame)._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) or broadcast_rows == 10


def test_no_sessions(spark):
    with pytest.raises(ValueError):
        GramClassifier.fit(spark.createDataFrame([], SCHEMA))
