"""Loading in one call, the common detector interface, and models that are written and read."""

import random

import numpy as np
import pytest
from emberlog.operators.classifiers import SparseSvm
from emberlog.operators.clustering import ClusterModel
from emberlog.operators.detectors import FITS, Detector
from emberlog.operators.invariants import InvariantModel
from emberlog.operators.sequence_models import NextEventSoftmax
from emberlog.sources import load
from pyspark.sql import functions as F


@pytest.fixture
def log(tmp_path):
    lines = []
    for i in range(40):
        block = f"blk_{i % 8}"
        lines.append(f"081109 2036{i:02d} 1 INFO dfs.X: " + (f"Receiving {block} src" if i % 3 else f"Deleting {block} now"))
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "t.csv").write_text("idx,pattern,args_keep\n0,Receiving (.*) src,0\n1,Deleting (.*) now,0\n")
    (tmp_path / "l.csv").write_text("BlockId,Label\n" + "".join(f"blk_{i},{'Anomaly' if i < 2 else 'Normal'}\n" for i in range(8)))
    return tmp_path


def test_raw_log_to_split_sessions(spark, log):
    got = load.load_sessions(spark, str(log / "a.log"), "hdfs_log", str(log / "t.csv"), str(log / "l.csv"), train_ratio=0.5, split_type="uniform")
    heads = {r.session_id: r for r in got.heads.collect()}
    assert {s: r.label for s, r in heads.items()} == {f"blk_{i}": int(i < 2) for i in range(8)}
    assert sorted(r.split for r in heads.values() if r.label) == ["test", "train"] and heads["blk_0"].split == "train"
    events = {r.session_id: r.events for r in got.chunks.collect()}
    assert events == {f"blk_{b}": [f"E{int(i % 3 == 0)}" for i in range(b, 40, 8)] for b in range(8)}
    assert {r.session_id for r in got.part("train").collect()} == {s for s, r in heads.items() if r.split == "train"}


def test_unlabelled_loads_warn(spark, log):
    with pytest.warns(UserWarning, match="sequentially"):
        got = load.load_sessions(spark, str(log / "a.log"), "hdfs_log", str(log / "t.csv"), train_ratio=0.25, split_type="uniform")
    assert {r.session_id for r in got.heads.where("split = 'train'").collect()} == {"blk_0", "blk_1"}
    with pytest.raises(ValueError):
        load.load_sessions(spark, str(log / "a.log"), "hdfs_log")
    with pytest.raises(ValueError):
        load.load_sessions(spark, str(log / "a.log"), "other")


def test_instance_files(spark, log):
    rows = [f"b{i},\"['E1', 'E{i}']\",{i % 2}" for i in range(6)]
    (log / "i.csv").write_text("BlockId,EventSequence,Label\n" + "\n".join(rows) + "\n")
    (log / "s.csv").write_text("EventSequence,Label\n" + "\n".join(r.split(",", 1)[1] for r in rows) + "\n")
    for kind, name in (("instances", "i.csv"), ("sequences", "s.csv")):
        got = load.load_sessions(spark, str(log / name), kind, train_ratio=0.5)
        heads = sorted(got.heads.collect(), key=lambda r: r.first_line)
        assert [(r.n_events, r.label, r.split) for r in heads] == [(2, i % 2, "train" if i < 3 else "test") for i in range(6)]
        events = {r.session_id: r.events for r in got.chunks.collect()}
        assert [events[r.session_id] for r in heads] == [["E1", f"E{i}"] for i in range(6)]


@pytest.fixture(scope="module")
def sessions(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson([2, 2, 1, 1], (120, 4)).astype(float)
    x[:, 3] = x[:, 0]
    bad = rng.random(120) < 0.15
    x[bad, 3] += 6
    rows = [(f"s{i:03d}", i, [float(v) for v in r], int(b)) for i, (r, b) in enumerate(zip(x, bad))]
    return spark.createDataFrame(rows, "session_id string, first_line bigint, features array<double>, label int").cache()


@pytest.mark.parametrize("name", FITS)
def test_every_detector_has_the_same_interface(spark, sessions, name):
    options = {"invariants": {"percentage": 0.7}, "isolation_forest": {"n_estimators": 10}, "pca": {"n_components": 3, "threshold": 4.0}}
    detector = Detector(name, options.get(name, {})).fit(sessions)
    out = detector.predict(sessions)
    assert out.columns == [*sessions.columns, "pred"] and out.count() == 120
    flagged = out.where("pred = 1 and label = 1").count()
    report = detector.evaluate(sessions).first()
    assert report["tp"] == flagged and report["tp"] + report["tn"] + report["fp"] + report["fn"] == 120
    if name in ("logistic_regression", "svm", "decision_tree"):
        assert report["f1"] > 0.9
        with pytest.raises(ValueError):
            Detector(name).fit(sessions.drop("label"))


def test_clustering_modes(spark, sessions):
    offline = Detector("clustering", {"mode": "offline", "max_dist": 0.2}).fit(sessions)
    none = Detector("clustering", {"mode": "online", "num_bootstrap_samples": 0, "max_dist": 0.2}).fit(sessions)
    for detector in (offline, none):
        assert detector.model.reps.agg(F.sum("size")).first()[0] == 120
    with pytest.raises(ValueError):
        Detector("clustering", {"mode": "neither"}).fit(sessions)


def test_models_are_written_and_read(spark, sessions, tmp_path):
    vectors = sessions.select("features").distinct()
    mined = InvariantModel({(0, 3): [1.0, -1.0], (2,): [1.0]}, 2)
    mined.write(str(tmp_path / "inv"), spark)
    assert InvariantModel.load(spark, str(tmp_path / "inv")) == mined
    svm = SparseSvm(np.array([1.0, -2.0, 0.0, 0.5, 0.25]))
    svm.write(str(tmp_path / "svm"), spark)
    assert np.array_equal(SparseSvm.load(spark, str(tmp_path / "svm")).weights, svm.weights)
    clusters = ClusterModel.fit_offline(sessions.select("features"), 0.3, 0.1)
    again = clusters.write(str(tmp_path / "clu"))
    assert sorted(map(tuple, again.predict(vectors).collect())) == sorted(map(tuple, clusters.predict(vectors).collect()))


@pytest.mark.parametrize("with_counts", [False, True])
def test_softmax_is_the_minimum(spark, with_counts):
    """No small change of a weight lowers the penalised log loss, and windows are ranked by the same numbers."""
    rng = random.Random(4)
    rows = [([rng.choice("ABC"), rng.choice("ABC")], rng.choice("AABC"), float(rng.randint(1, 5))) for _ in range(60)]
    train = spark.createDataFrame(rows, "context array<string>, next string, weight double")
    vocab, reg = ["A", "B", "C"], 0.01
    model = NextEventSoftmax.fit(train, 2, vocab, with_counts, reg_param=reg, max_iter=200)
    fitted = model.model.stages[-1]
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    slots = [f"{i}={e}" for i in range(2) for e in vocab]
    x = np.array([[float(f"{i}={c[i]}" == s) for s in slots for i in [int(s[0])]] + ([c.count(v) for v in vocab] if with_counts else []) for c, *_ in rows])
    y = np.array([[float(n == v) for v in vocab] for _, n, _ in rows])
    weight = np.array([k for *_, k in rows])
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    slope = ((p - y) * weight[:, None]).T @ x / weight.sum() + reg * w
    assert np.abs(slope).max() < 2e-3 and np.abs(((p - y) * weight[:, None]).sum(axis=0) / weight.sum()).max() < 2e-3
    ahead = {(tuple(r.context), r.next): r.ahead for r in model.ahead(train.select("context", "next").distinct()).collect()}
    for (c, n, _), q in zip(rows, p):
        assert ahead[tuple(c), n] == int((q > q[vocab.index(n)] + 1e-12).sum())
