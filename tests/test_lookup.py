"""Dictionary joins: small and large tables, skewed and unknown symbols, and plans without a shuffle by symbol."""

import pytest
from emberlog.functions.sequences import PAD
from emberlog.operators import collect, features, lookup, seqwin
from emberlog.operators.features import FeatureModel
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 200_000])
def test_encoding_keeps_order_and_empty_rows(spark, limit):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "?"]), (2, []), (3, ["a"] * 40)], "id int, events array<string>")
    table = spark.createDataFrame([("a", 10), ("b", 20)], "event string, value int")
    got = {r.id: r.events for r in lookup.encoded(rows, "events", table, ["id"], F.lit(-1), limit).collect()}
    assert got == {1: [20, 10, 20, -1], 2: [], 3: [10] * 40}


def test_three_hundred_thousand_symbols(spark):
    """More symbols than may be broadcast or read to the driver: indexes, counts and templates still come out."""
    n = 300_000
    name = F.concat(F.lit("e"), F.col("id").cast("string"))
    vocab = spark.range(n).select(name.alias("event"), F.col("id").alias("idx"))
    chunks = spark.createDataFrame(
        [("s", 0, ["e0", "e299999", "e0", "none"]), ("t", 0, ["e7"] * 30), ("t", 1, ["e123456"])],
        "session_id string, chunk int, events array<string>",
    )
    got = {(r.session_id, r.chunk): r.events for r in seqwin.indexed(chunks, "events", vocab, ["session_id", "chunk"]).collect()}
    assert got == {("s", 0): [0, 299_999, 0, -1], ("t", 0): [7] * 30, ("t", 1): [123_456]}
    templates = vocab.select(F.col("event").alias("EventId"), F.concat(F.lit("T"), F.col("idx").cast("string")).alias("EventTemplate"))
    named = collect.expand_templates(chunks.where("session_id = 't'"), templates).collect()
    assert {tuple(r.events) for r in named} == {("e7 T7",) * 30, ("e123456 T123456",)}
    with pytest.raises(Exception, match="no template for event none"):
        collect.expand_templates(chunks, templates).collect()


def test_window_counts(spark):
    wins = spark.createDataFrame([(1, ["B", "B", PAD]), (2, ["?", "A", "B"]), (3, [PAD] * 3), (4, ["B", "B", PAD])], "id int, win array<string>")
    vocab = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2), (PAD, 3)], "event string, idx bigint")
    got = {r.id: r.counts for r in seqwin.count_vectors(wins, "win", vocab, 3).collect()}
    assert got == {1: [0, 2, 0], 2: [1, 1, 0], 3: [0, 0, 0], 4: [0, 2, 0]}


@pytest.mark.parametrize("normalization", [None, "zero-mean", "sigmoid"])
def test_features_never_shuffle_by_event(spark, make_rows, normalization):
    counts = features.event_counts(make_rows({"a": ["A", "A", "B"], "b": ["B", "Z"], "c": ["Y"]})).cache()
    model = FeatureModel.fit(counts.where("session_id <> 'c'"), "tf-idf", normalization, oov=True, min_count=2)
    for frame in (model.transform(counts), model.transform_sparse(counts), features.oov_counts(counts, model.table)):
        plan = plan_of(frame)
        assert "BroadcastHashJoin" in plan and "hashpartitioning(event" not in plan
    wide = {r.session_id: r.features for r in model.transform(counts).collect()}
    sparse = {}
    for r in model.transform_sparse(counts).collect():
        sparse[r.session_id, r.idx] = r.x
    means = {r.idx: r["mean"] if normalization == "zero-mean" else 0.0 for r in model.table.collect()}
    assert wide.keys() == {"a", "b", "c"}
    for session, values in wide.items():
        assert values == pytest.approx([sparse.get((session, i), 0.0) - means[i] for i in range(len(values))])


def test_a_large_vocabulary_is_salted(spark, make_rows, monkeypatch):
    counts = features.event_counts(make_rows({f"s{i}": ["A"] * (i + 1) + [f"e{i}"] for i in range(20)}))
    vocab = features.vocabulary_with_df(counts)
    few = lookup.looked_up(counts, vocab, "event", limit=3)
    assert "BroadcastHashJoin" not in plan_of(few) and "_salt" in plan_of(few)
    want = sorted(map(tuple, lookup.looked_up(counts, vocab, "event").select("session_id", "event", "cnt", "idx").collect()))
    assert sorted(map(tuple, few.select("session_id", "event", "cnt", "idx").collect())) == want
