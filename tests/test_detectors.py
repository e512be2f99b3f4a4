import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import classifiers, clustering, gram, iforest, invariants
from emberlog.operators.clustering import ClusterModel
from emberlog.operators.components import components
from emberlog.operators.iforest import ForestModel
from emberlog.operators.invariants import InvariantModel
from emberlog.operators.pca import PcaModel, component_count


def frame(spark, matrix, weights=None, **columns):
    weights = np.ones(len(matrix)) if weights is None else weights
    rows = [
        ([float(v) for v in row], float(w), f"s{i:04d}", i, *[c[i] for c in columns.values()])
        for i, (row, w) in enumerate(zip(matrix, weights, strict=True))
    ]
    names = "".join(f", {c} int" for c in columns)
    return spark.createDataFrame(
        rows, "features array<double>, weight double, session_id string, first_line bigint" + names
    ).repartition(3)


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(0)
    return rng.poisson(1.0, size=(120, 5)).astype(float)


def test_gram(spark, counts):
    weights = np.arange(len(counts)) % 4 + 1.0
    got = gram.gram_matrix(frame(spark, counts, weights).select("features", "weight"), 5)
    assert np.allclose(got, counts.T @ (counts * weights[:, None]))


@pytest.mark.parametrize("n_components", [0.8, 0.95, 2])
def test_subspace_equals_numpy(spark, counts, n_components):
    vectors = frame(spark, counts).select("features", "weight")
    model = PcaModel.fit(vectors, 5, n_components)
    u, sigma, _ = np.linalg.svd(counts.T @ counts / len(counts))
    k = component_count(sigma, n_components)
    residual = np.eye(5) - u[:, :k] @ u[:, :k].T if k < 5 else np.zeros((5, 5))
    assert model.n_components == k
    assert np.allclose(model.projector, residual)
    spe = {tuple(r["features"]): r["spe"] for r in model.score(vectors).collect()}
    assert all(math.isclose(spe[tuple(x)], float(x @ residual @ x), abs_tol=1e-9) for x in counts)
    if k < 5:
        phi = [float(np.sum(sigma[k:] ** p)) for p in (1, 2, 3)]
        h0 = 1 - 2 * phi[0] * phi[2] / (3 * phi[1] ** 2)
        limit = phi[0] * (
            3.2905 * math.sqrt(2 * phi[1] * h0**2) / phi[0] + 1 + phi[1] * h0 * (h0 - 1) / phi[0] ** 2
        ) ** (1 / h0)
        assert model.threshold == pytest.approx(limit)


def test_sparse_gram_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(gram, "FLUSH", 40)
    rng = np.random.default_rng(5)
    x = rng.poisson(0.1, (90, 30)).astype(float)
    weights = np.arange(90) % 3 + 1.0
    vectors = frame(spark, x, weights).select("features", "weight")
    assert np.allclose(gram.gram_matrix(vectors, 30), x.T @ (x * weights[:, None]))
    assert gram.gram_rows(vectors).where("i > j or g = 0").isEmpty()


@pytest.mark.parametrize("n_components", [0.8, 0.95, 3, 20])
def test_passes_equal_the_matrix(spark, n_components, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.poisson(np.linspace(0.2, 3, 20), (150, 20)).astype(float)
    vectors = frame(spark, x).select("features", "weight")
    dense, wide = (PcaModel.fit(vectors, 20, n_components, dense=d) for d in (100, 0))
    assert dense.n_components == wide.n_components
    assert np.allclose(dense.projector, wide.projector, atol=1e-6)
    assert dense.threshold == pytest.approx(wide.threshold, rel=1e-5, abs=1e-9)
    wide.write(str(tmp_path / "pca"), spark)
    assert np.allclose(PcaModel.load(spark, str(tmp_path / "pca")).projector, wide.projector)


def test_five_thousand_columns(spark):
    """Only the kept directions are computed: 5,000 x 4 numbers in place of 25 million."""
    rng = np.random.default_rng(7)
    x = np.zeros((200, 5_000))
    for i, row in enumerate(x):
        row[rng.choice(5_000, 4, replace=False)] = 1
        row[10 * (i % 4) : 10 * (i % 4) + 8] += 3 + i % 4
    model = PcaModel.fit(frame(spark, x).select("features", "weight"), 5_000, 4, threshold=9.0)
    u = np.linalg.svd(x, full_matrices=False)[2][:4].T
    assert model.main.shape == (5_000, 4) and np.allclose(np.abs(np.linalg.svd(u.T @ model.main)[1]), 1, atol=1e-6)


def test_full_subspace_flags_nothing(spark, counts):
    vectors = frame(spark, counts).select("features", "weight")
    assert PcaModel.fit(vectors, 5, 5).score(vectors).where("pred = 1").count() == 0


def test_equal_columns_are_an_invariant(spark):
    rng = np.random.default_rng(1)
    a, c = rng.integers(0, 5, 60), rng.integers(0, 5, 60)
    vectors = frame(spark, np.column_stack([a, a, c, np.zeros(60)])).select("features", "weight")
    model = InvariantModel.fit(vectors, 4)
    assert model.invariants[(3,)] == [1.0]
    pair = model.invariants[(0, 1)]
    assert pair in ([1.0, -1.0], [-1.0, 1.0])
    broken = frame(spark, np.array([[1, 1, 5, 0], [1, 2, 5, 0], [2, 2, 0, 1]])).select("features", "weight")
    got = {tuple(r["features"]): r["pred"] for r in model.predict(broken).collect()}
    assert got == {(1, 1, 5, 0): 0, (1, 2, 5, 0): 1, (2, 2, 0, 1): 1}


def test_three_way_invariant_and_pruning(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 6, 80), rng.integers(1, 6, 80)
    matrix = np.column_stack([a, b, a + b, rng.integers(0, 7, 80)])
    model = InvariantModel.fit(frame(spark, matrix).select("features", "weight"), 4)
    assert list(model.invariants) == [(0, 1, 2)]
    w = np.array(model.invariants[0, 1, 2])
    assert np.allclose(matrix[:, :3] @ w, 0) and np.abs(w).min() == 1


def test_longest_stops_the_search(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 6, 80), rng.integers(1, 6, 80)
    vectors = frame(spark, np.column_stack([a, b, a + b])).select("features", "weight")
    assert InvariantModel.fit(vectors, 3, longest=2).invariants == {}


def mined_one_by_one(x, percentage, epsilon, longest=None):
    """The search in its plain order: every set tested on all rows, sets closed as invariants are found."""
    n, k = x.shape
    u = np.linalg.svd(x.T @ x)[0]
    wanted = 0
    for i in range(k - 1, -1, -1):
        if np.sum(np.abs(x @ u[:, i]) < epsilon) / n < percentage:
            break
        wanted += 1
    found = {(c,): [1.0] for c in range(k) if not x[:, c].any()}
    open_ = {(c,) for c in range(k)} - set(found)
    failed, length = sorted(open_), 2
    while failed and not (longest and length > longest):
        joined = sorted({tuple(sorted({*a, *b})) for a, b in combinations(failed, 2) if len({*a, *b}) == length})
        whole = lambda s: all(p in open_ for p in combinations(s, length - 1))  # noqa: E731, B023
        open_ |= {s for s in joined if whole(s)}
        failed = []
        for cols in joined:
            if cols not in open_ or not whole(cols):
                open_.discard(cols)
                continue
            theta = np.linalg.svd(x[:, cols].T @ x[:, cols])[0][:, -1]
            weights = None
            for scale in (1, 2, 3) if np.all(np.abs(theta) >= 1e-6) else ():
                least = int(np.argmin(np.abs(theta)))
                w = np.array([round(v * (scale / theta[least])) for v in theta], dtype=float)
                w[least] = scale
                if np.all(w != 0) and np.sum(np.abs(x[:, cols] @ w) < 1e-8) >= percentage * n:
                    weights = w.tolist()
                    break
            if weights is None:
                failed.append(cols)
            else:
                for earlier in found:
                    both = set(cols) | set(earlier)
                    open_ -= {tuple(sorted(both - {c})) for c in set(cols) & set(earlier)}
                found[cols] = weights
                open_.discard(cols)
            if len(found) >= wanted:
                return wanted, found
        length += 1
    return wanted, found


@pytest.mark.parametrize("seed", range(6))
def test_mining_equals_the_plain_search(spark, seed):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 4, (3, 70))
    noise = rng.integers(0, 3, 70)
    columns = [a, b, a + b, c, c + a, 2 * b, noise, np.zeros(70), a + (rng.random(70) < 0.05)]
    x = np.column_stack([columns[i] for i in rng.permutation(9)[: 5 + seed % 4]]).astype(float)
    if seed == 5:
        x = rng.integers(0, 3, (70, 6)).astype(float)  # nothing holds
    percentage, epsilon = (0.98, 0.5) if seed % 2 else (0.5, 0.8)
    wanted, found = mined_one_by_one(x, percentage, epsilon)
    model = InvariantModel.fit(frame(spark, x).select("features", "weight"), x.shape[1], percentage, epsilon)
    assert model.dimension == wanted and list(model.invariants) == list(found)
    for cols, weights in found.items():
        assert model.invariants[cols] in (weights, [-w for w in weights])


def test_mining_of_many_columns(spark):
    """300 columns: 44,850 pairs are candidates, but hardly any leaves the bounds, and none passes the driver."""
    rng = np.random.default_rng(3)
    x = rng.poisson(1.5, (150, 300)).astype(float)
    x[:, 299] = x[:, 7]
    vectors = frame(spark, x).select("features", "weight")
    moments = invariants.Moments.of(vectors, 300)
    pairs = invariants._next_sets(spark, None, list(range(300)), 2)
    assert pairs.count() == 44_850
    assert invariants._tries(pairs, moments, 150 * 0.02).count() < 1_000
    assert [tuple(r["items"]) for r in invariants.holding(vectors, pairs, moments, 0.98).collect()] == [(7, 299)]


def test_validate_counts_every_candidate(spark, counts):
    vectors = frame(spark, counts).select("features", "weight")
    g = counts.T @ counts
    sets = [c for n in (2, 3) for c in combinations(range(5), n)]
    got = invariants.validate(vectors, g, len(counts), sets, 0.3, stripe_bytes=300)
    expected = {}
    for cols in sets:
        for scale in invariants.SCALES:
            w = invariants.integer_weights(g, cols, scale)
            if w is not None and np.sum(np.abs(counts[:, cols] @ w) < 1e-8) >= 0.3 * len(counts):
                expected.setdefault(cols, w.tolist())
    assert got == expected


def distance(x, y):
    d = 1 - x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8)
    return 0.0 if d < 1e-8 else d


@pytest.mark.parametrize("block", [3, 2048])
@pytest.mark.parametrize("max_dist", [0.05, 0.3, 0.9])
def test_close_pairs_equal_all_pairs(spark, counts, block, max_dist):
    points = np.unique(counts, axis=0)
    numbered = frame(spark, points).select(F.col("first_line").alias("id"), "features")
    got = {(r["a"], r["b"]): r["d"] for r in clustering.close_pairs(numbered, max_dist, block).collect()}
    expected = {}
    for i, j in combinations(range(len(points)), 2):
        d = distance(points[i], points[j])
        if d <= max_dist:
            expected[i, j] = d
    assert got.keys() == expected.keys()
    assert all(got[p] == pytest.approx(expected[p], abs=1e-12) for p in got)


def test_close_pairs_of_signed_vectors(spark, counts):
    points = np.unique(counts, axis=0).astype(float)
    points = points - points.mean(axis=0)
    numbered = frame(spark, points).select(F.col("first_line").alias("id"), "features")
    got = {(r["a"], r["b"]) for r in clustering.close_pairs(numbered, 0.3).collect()}
    assert got == {(i, j) for i, j in combinations(range(len(points)), 2) if distance(points[i], points[j]) <= 0.3}


def one_by_one(points, limit):
    """Complete linkage: the closest pair of clusters merges, ties by the lowest members."""
    clusters = [{i} for i in range(len(points))]
    d = np.round(clustering.distances(points, points), clustering.DIGITS)
    while True:
        best = None
        for p, q in combinations(range(len(clusters)), 2):
            far = max(d[i, j] for i in clusters[p] for j in clusters[q])
            key = (far, *sorted((min(clusters[p]), min(clusters[q]))))
            if far <= limit and (best is None or key < best[0]):
                best = (key, p, q)
        if best is None:
            return sorted(map(sorted, clusters))
        clusters[best[1]] |= clusters[best[2]]
        del clusters[best[2]]


@pytest.mark.parametrize(
    "options", [{}, {"block": 7}, {"solve_rows": 0}, {"solve_rows": 0, "block": 5}, {"solve_pairs": 12, "block": 9}]
)
def test_complete_linkage_equals_merging_one_by_one(spark, options):
    """In one task, in rounds and mixed, with many equal distances, zero vectors and vectors far from all."""
    rng = np.random.default_rng(4)
    points = np.vstack([rng.integers(0, 3, (40, 5)), rng.integers(0, 9, (8, 5)), np.zeros((2, 5)), 7 * np.eye(5)])
    points = np.unique(points, axis=0).astype(float)
    numbered = frame(spark, points).select(F.col("first_line").alias("id"), "features")
    for limit in (0.08, 0.3):
        got = {}
        for r in clustering.complete_linkage(numbered, limit, **options).collect():
            assert r["cluster"] <= r["id"]
            got.setdefault(r["cluster"], set()).add(r["id"])
        assert all(min(ids) == name for name, ids in got.items())
        assert sorted(map(sorted, got.values())) == one_by_one(points, limit)


def test_a_dense_group_sends_no_pairs(spark):
    """300 vectors that are all close: at most a row per vector and cell, not 45,000 pairs."""
    rng = np.random.default_rng(8)
    points = 10 + rng.random((300, 3))
    numbered = frame(spark, points).select(F.col("first_line").alias("id"), "features").cache()
    links = clustering.close_links(numbered, 0.2, block=100)
    rows = links.agg(F.count(F.lit(1)).alias("n"), F.sum("pairs").alias("pairs")).first()
    assert rows["pairs"] == 300 * 299 // 2 and rows["n"] <= 6 * 300
    assert clustering.complete_linkage(numbered, 0.2).select("cluster").distinct().count() == 1


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    want = {x: x for link in links for x in link}
    for _ in range(len(want)):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    table = spark.createDataFrame(links, "a bigint, b bigint")
    for bound in (0, 10_000):
        assert {r.id: r.component for r in components(table, bound).collect()} == want


def test_nearest_over_several_stripes(spark, counts):
    reps = np.unique(counts, axis=0)[:10]
    table = spark.createDataFrame([(i, [float(v) for v in r], 1.0) for i, r in enumerate(reps)], "cluster bigint, center array<double>, size double")
    vectors = frame(spark, counts[:30]).select("features", "weight")
    for r in clustering.nearest(vectors, table, stripe=4).collect():
        all_d = [distance(np.array(r["features"]), c) for c in reps]
        assert r["distance"] == pytest.approx(min(all_d))
        assert all_d[r["cluster"]] == pytest.approx(min(all_d))


def test_zero_vector_is_far_from_everything(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], 1.0)], "cluster bigint, center array<double>, size double")
    vectors = frame(spark, np.array([[0.0, 0.0]])).select("features", "weight")
    row = ClusterModel(table).predict(vectors).first()
    assert (row["distance"], row["pred"]) == (1.0, 1)


def test_online_clusters_cover_all_sessions(spark, counts):
    points = counts[counts.sum(axis=1) > 0]
    sessions = frame(spark, points).drop("weight")
    model = ClusterModel.fit_online(sessions, max_dist=0.2, num_bootstrap_samples=30)
    reps = model.reps.collect()
    assert len({r["cluster"] for r in reps}) == len(reps)
    assert sum(r["size"] for r in reps) == len(points)
    total = sum(np.array(r["center"]) * r["size"] for r in reps)
    assert np.allclose(total, points.sum(axis=0))


def test_representatives_are_weighted_means(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], 3.0), (1, [0.0, 2.0], 1.0), (2, [5.0, 5.0], 2.0)],
        "cluster bigint, features array<double>, weight double",
    )
    got = {r["cluster"]: (r["center"], r["size"]) for r in clustering.representatives(df).collect()}
    assert got == {1: ([0.75, 0.5], 4.0), 2: ([5.0, 5.0], 2.0)}


def test_weighted_percentile_equals_numpy(spark):
    rng = random.Random(6)
    values = [(round(rng.random(), 2), float(rng.randint(1, 4))) for _ in range(200)]
    df = spark.createDataFrame(values, "score double, weight double")
    flat = np.repeat([v for v, _ in values], [int(w) for _, w in values])
    for share in (0.0, 0.5, 0.97, 1.0):
        assert iforest.weighted_percentile(df, "score", share) == pytest.approx(np.percentile(flat, share * 100))


def test_forest_finds_a_far_point(spark):
    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(0, 1, (300, 3)), [[25, 25, 25]]])
    rows = frame(spark, points)
    model = ForestModel.fit(rows, n_estimators=30, contamination=0.01, seed=1)
    scored = {r["session_id"]: (r["score"], r["pred"]) for r in model.predict(rows).collect()}
    assert scored["s0300"][1] == 1
    assert max(scored, key=lambda s: scored[s][0]) == "s0300"
    assert sum(p for _, p in scored.values()) <= 0.01 * 301 + 1
    per_tree = model.nodes.groupBy("tree").agg(F.sum((F.col("feature") < 0).cast("int")).alias("leaves"))
    assert per_tree.count() == 30 and per_tree.agg(F.max("leaves")).first()[0] <= 256


def test_forest_with_a_fixed_cut(spark, counts):
    model = ForestModel.fit(frame(spark, counts), n_estimators=5, contamination="auto")
    assert model.threshold == 0.5
    assert {r["pred"] == int(r["score"] > 0.5) for r in model.predict(frame(spark, counts)).collect()} == {True}


def test_forest_options(spark, counts):
    rows = frame(spark, counts)
    model = ForestModel.fit(rows, n_estimators=5, max_samples=0.5, max_features=2, bootstrap=True)
    assert model.sample_size == 60
    used = model.nodes.where("feature >= 0").groupBy("tree").agg(F.count_distinct("feature").alias("n"))
    assert used.agg(F.max("n")).first()[0] <= 2


def test_draws_are_the_least_hashes(spark, counts):
    rows = frame(spark, counts)
    for size in (7, 60, 120):
        got = iforest._drawn(rows, 4, size, 120, 3).collect()
        assert sorted((r.tree, r.place) for r in got) == [(t, i) for t in range(4) for i in range(size)]
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(3), "tree", "session_id"), 2)
        order = rows.crossJoin(spark.range(4).select(F.col("id").cast("int").alias("tree"))).withColumn("draw", draw)
        want = {(r.tree, tuple(r.features)) for t in range(4) for r in order.where(F.col("tree") == t).orderBy("draw").limit(size).collect()}
        assert {(r.tree, tuple(r.features)) for r in got} == want


@pytest.mark.parametrize("bootstrap", [False, True])
def test_large_samples_are_split_over_tasks(spark, counts, bootstrap):
    """Parts of at most ten rows a task: the trees are whole, their leaves hold all points, cuts lie in range."""
    model = ForestModel.fit(frame(spark, counts), 6, max_samples=0.9, max_features=4, bootstrap=bootstrap, task_rows=10, contamination="auto")
    assert model.sample_size == 108
    for tree, nodes in model.nodes.toPandas().groupby("tree"):
        known = dict(zip(nodes["node"], nodes["feature"]))
        assert len(known) == len(nodes) and 1 in known
        assert all((2 * n in known and 2 * n + 1 in known) == (f >= 0) for n, f in known.items())
        assert int(nodes["node"].max()).bit_length() - 1 <= math.ceil(math.log2(108))
        assert set(nodes.loc[nodes["feature"] >= 0, "feature"]) <= set(iforest.tree_columns(5, 6, 4, 42)[tree].tolist())


def test_scores_of_blocks_equal_scores_of_the_whole(spark, counts, monkeypatch, tmp_path):
    model = ForestModel.fit(frame(spark, counts), 8, contamination=0.1)
    whole = {tuple(r.features): r.score for r in model.predict(frame(spark, counts)).collect()}
    monkeypatch.setattr(iforest, "BLOCK_NODES", 600)
    monkeypatch.setattr(iforest, "STRIPE", 30)
    loaded = model.write(str(tmp_path / "forest"))
    loaded.small_nodes = 0
    assert loaded.threshold == model.threshold
    got = loaded.predict(frame(spark, counts)).collect()
    assert len(got) == len(counts) and all(whole[tuple(r.features)] == pytest.approx(r.score, abs=1e-12) for r in got)


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(8)
    x = rng.poisson(2.0, size=(200, 3)).astype(float)
    return x, (x[:, 0] > x[:, 1] + 1).astype(int)


def test_classifiers_learn_a_linear_rule(spark, labelled):
    x, y = labelled
    train = frame(spark, x, label=[int(v) for v in y])
    for fit in (
        classifiers.logistic_regression,
        classifiers.linear_svm,
        classifiers.decision_tree,
        lambda t: classifiers.decision_tree(t, max_features=2, max_depth=5),
        lambda t: classifiers.SparseSvm.fit(t, 3),
    ):
        out = fit(train.select("features", "label")).predict(train).where("pred = label")
        assert out.count() >= 0.9 * len(x)


def test_sparse_svm_reaches_the_minimum(spark, labelled):
    x, y = labelled
    signed = np.where(y > 0, 1.0, -1.0)
    rows = np.column_stack([x, np.ones(len(x))]) * signed[:, None]

    def loss(w):
        return np.abs(w).sum() + np.sum(np.maximum(1 - rows @ w, 0) ** 2)

    w, step = np.zeros(4), 1 / (2 * np.linalg.eigvalsh(rows.T @ rows)[-1])
    for _ in range(30_000):
        g = w + step * 2 * (np.maximum(1 - rows @ w, 0) @ rows)
        w = np.sign(g) * np.maximum(np.abs(g) - step, 0)
    model = classifiers.SparseSvm.fit(
        frame(spark, x, label=[int(v) for v in y]).select("features", "label"), 3, tol=1e-4
    )
    assert loss(model.weights) == pytest.approx(loss(w), rel=1e-4)
    # No direction lowers the loss: the slope is -sign(w) where w is not 0, and at most 1 elsewhere.
    slope = -2 * (np.maximum(1 - rows @ model.weights, 0) @ rows)
    start = np.abs(classifiers.least_subgradient(np.zeros(4), -2 * rows.sum(axis=0))).max()
    assert np.abs(classifiers.least_subgradient(model.weights, slope)).max() <= 1.01e-4 * start


def test_sparse_svm_of_many_columns(spark):
    """400 columns, few of which matter: a number per column leaves a partition, and most weights are 0."""
    rng = np.random.default_rng(9)
    x = rng.poisson(0.3, (300, 400)).astype(float)
    y = (x[:, 3] + x[:, 70] > x[:, 200] + 0.5).astype(int)
    train = frame(spark, x, label=[int(v) for v in y]).select("features", "label")
    model = classifiers.SparseSvm.fit(train, 400, c=0.2, tol=1e-3)
    rows = np.column_stack([x, np.ones(300)]) * np.where(y > 0, 1.0, -1.0)[:, None]
    slope = -0.4 * (np.maximum(1 - rows @ model.weights, 0) @ rows)
    assert np.abs(classifiers.least_subgradient(model.weights, slope)).max() < 0.1
    assert np.count_nonzero(model.weights) < 150 and {3, 70, 200} <= set(np.flatnonzero(model.weights).tolist())
