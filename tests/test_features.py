import math

import pytest
from pyspark.sql import functions as F

from emberlog.operators import features
from emberlog.operators.features import OOV, FeatureModel


@pytest.fixture
def counts(make_rows):
    def build(sessions):
        return features.event_counts(make_rows(sessions))

    return build


def sparse(model, frame):
    return {(r["session_id"], r["event"]): r["x"] for r in model.transform_sparse(frame).collect()}


def test_tfidf_by_hand(counts):
    frame = counts({"a": ["A", "A", "A"], "b": ["B"]})
    got = sparse(FeatureModel.fit(frame, "tf-idf"), frame)
    assert got["a", "A"] == pytest.approx(3 * math.log(2 / (1 + 1e-8)))


def test_rare_events_become_the_unknown_column(counts):
    frame = counts({"s": ["A", "B"], "t": ["A", "C", "D"]})
    vocab = features.vocabulary_with_df(frame, 2)
    assert [r["event"] for r in vocab.collect()] == ["A"]
    assert {r["session_id"]: r["oov"] for r in features.oov_counts(frame, vocab).collect()} == {"s": 1, "t": 2}
    model = FeatureModel.fit(frame, oov=True, min_count=2)
    assert sparse(model, frame) == {("s", "A"): 1, ("s", OOV): 1, ("t", "A"): 1, ("t", OOV): 2}
    wide = {r["session_id"]: r["features"] for r in model.transform(frame).collect()}
    assert wide == {"s": [1, 1], "t": [1, 2]}


def test_min_count_needs_the_unknown_column(counts):
    frame = counts({"s": ["A", "B"], "t": ["A"]})
    assert FeatureModel.fit(frame, min_count=2).table.count() == 2


def test_zero_mean_uses_training_means(counts):
    train, test = counts({"a": ["A", "A"], "b": ["B"]}), counts({"c": ["B", "Z"], "d": ["Z"]})
    model = FeatureModel.fit(train, None, "zero-mean")
    got = {r["session_id"]: r["features"] for r in model.transform(test).collect()}
    assert got == {"c": [-1.0, 0.5], "d": [-1.0, -0.5]}


def test_sigmoid_leaves_zeros(counts):
    frame = counts({"a": ["A"], "b": ["B"]})
    got = {r["session_id"]: r["features"] for r in FeatureModel.fit(frame, None, "sigmoid").transform(frame).collect()}
    assert got["a"] == pytest.approx([1 / (1 + math.exp(-1)), 0.0])


def test_model_round_trip(spark, counts, tmp_path):
    frame = counts({"a": ["A", "A"], "b": ["B"]})
    model = FeatureModel.fit(frame, "tf-idf", oov=True)
    model.write(str(tmp_path / "m"))
    again = FeatureModel.load(spark, str(tmp_path / "m"), term_weighting="tf-idf", oov=True)
    assert sparse(again, frame) == sparse(model, frame)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    got = {r["label"]: r["class_weight"] for r in features.class_weights(df).collect()}
    assert got == pytest.approx({1: 2.0, 0: 4 / 6})
    got = {r["label"]: r["class_weight"] for r in features.class_weights(df, {1: 5.0}).collect()}
    assert got == {1: 5.0, 0: 1.0}


def test_wide_counts(counts):
    frame = counts({"a": ["A", "C", "A"], "b": ["B"]})
    got = {r["session_id"]: r["features"] for r in features.count_vectors(frame, ["A", "B", "C"]).collect()}
    assert got == {"a": [2, 0, 1], "b": [0, 1, 0]}
    weights = features.distinct_vectors(features.count_vectors(frame, ["C", "X"]).withColumn("k", F.lit(1)))
    assert sorted((r["features"], r["weight"]) for r in weights.collect()) == [([0, 0], 1), ([1, 0], 1)]
