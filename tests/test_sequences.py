import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.functions.sequences import PAD, dense_vector, one_hot_label, pad_left, pad_right
from emberlog.operators import evaluate, likelihood, seqwin, sessions
from emberlog.operators.nextevent import NextEventModel
from emberlog.session import stage


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_padding(spark):
    ab = F.array(F.lit("A"), F.lit("B"))
    assert one(spark, pad_left(ab, 4)) == [PAD, PAD, "A", "B"]
    assert one(spark, pad_left(ab, 1)) == ["A", "B"]
    assert one(spark, pad_right(ab, 3)) == ["A", "B", PAD]
    assert one(spark, pad_right(F.array(*map(F.lit, "ABCD")), 3)) == list("ABC")
    entries = F.from_json(F.lit('[{"idx": 1, "x": 2.5}, {"idx": 2, "x": -1}, {"idx": 5, "x": 7}]'), "array<struct<idx: bigint, x: double>>")
    assert one(spark, dense_vector(entries, 7)) == [0, 2.5, -1, 0, 0, 7, 0]
    assert one(spark, dense_vector(F.filter(entries, lambda e: e["x"] > 9), 2)) == [0, 0]
    assert one(spark, one_hot_label(F.lit(1))) == [0, 1]


def chunks_of(rows, chunk_len=4, halo=3):
    return sessions.session_chunks(sessions.with_positions(rows), chunk_len=chunk_len, halo=halo)


def test_next_event_windows(spark, make_rows):
    wins = seqwin.next_event_windows(chunks_of(make_rows({"a": list("ABCD"), "b": list("AB")})), 2, 4, 3).collect()
    assert sorted((r["session_id"], r["pos"], r["context"], r["next"]) for r in wins) == [
        ("a", 0, ["A", "B"], "C"),
        ("a", 1, ["B", "C"], "D"),
    ]
    again = seqwin.windows(chunks_of(make_rows({"b": list("AB")})), 2, 4, 3).collect()
    assert [r["win"] for r in again] == [["A", "B"]]


def test_distinct_sequences_by_print(spark, make_rows):
    plain = {"a": list("ABAB"), "b": list("ABAB"), "c": list("BABA"), "d": list("ABA"), "e": list("ABAB")}
    got = seqwin.distinct_sequences(sessions.with_positions(make_rows(plain))).collect()
    assert sorted((r["session_id"], r["weight"]) for r in got) == [("a", 3), ("c", 1), ("d", 1)]


def naive_model(train, h):
    table = Counter()
    for ctx, nxt in set(train):
        for k in range(h + 1):
            table[(k, ctx[len(ctx) - k :], nxt)] += 1
    return table


def naive_dist(table, ctx):
    for k in range(len(ctx), -1, -1):
        found = {n: c for (kk, s, n), c in table.items() if kk == k and s == ctx[len(ctx) - k :]}
        if found:
            return found
    return {}


@pytest.fixture(scope="module")
def random_windows(spark):
    rng = random.Random(5)
    train = [(tuple(rng.choices("ABCD", k=3)), rng.choice("ABC")) for _ in range(60)]
    test = [(tuple(rng.choices("ABCDE", k=3)), rng.choice("ABCDE")) for _ in range(80)]
    return train, test


def frame(spark, wins):
    rows = [(f"s{i % 7}", i, list(c), n) for i, (c, n) in enumerate(wins)]
    return spark.createDataFrame(rows, "session_id string, pos bigint, context array<string>, next string")


def test_back_off_and_top_g(spark, random_windows):
    train, test = random_windows
    table = naive_model(train, 3)
    model = NextEventModel.fit(frame(spark, train).select("context", "next").distinct(), 3).staged()
    got = {r["pos"]: r["hit"] for r in model.hits(frame(spark, test), 2).collect()}
    for i, (ctx, nxt) in enumerate(test):
        dist = naive_dist(table, ctx)
        assert got[i] == (sum(c > dist.get(nxt, 0) for c in dist.values()) < 2)


def test_log_likelihood_is_clipped(spark, random_windows):
    import math

    train, test = random_windows
    table = naive_model(train, 3)
    model = NextEventModel.fit(frame(spark, train).select("context", "next").distinct(), 3)
    got = {r["pos"]: r["ll"] for r in model.log_likelihood(frame(spark, test)).collect()}
    for i, (ctx, nxt) in enumerate(test):
        dist = naive_dist(table, ctx)
        p = max(dist.get(nxt, 0) / sum(dist.values()), 1e-7)
        assert got[i] == pytest.approx(math.log(p))


def test_ties_pass_the_top_g_rule(spark):
    target, weights = F.lit(0.4), F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))
    assert one(spark, evaluate.symbols_ahead(target, F.lit(1.0), weights)) == 0


def test_likelihood_windows_of_short_sessions_are_padded(spark, make_rows):
    rows = make_rows({"a": list("ABAB"), "b": ["A"]})
    chunks = chunks_of(rows)
    model = likelihood.fit_window_model(chunks, 2, chunk_len=4, halo=3)
    wins = likelihood.window_log_likelihood(model, chunks, 2, chunk_len=4, halo=3).collect()
    assert sorted((r["session_id"], r["pos"]) for r in wins) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_score_distinct_reaches_every_occurrence(spark, make_rows):
    wins = seqwin.windows(chunks_of(make_rows({"a": list("ABABAB")})), 2, 4, 3)
    out = seqwin.score_distinct(wins, "win", lambda d: d.withColumn("first", F.col("win")[0]))
    assert sorted((r["pos"], r["first"]) for r in out.collect()) == list(enumerate("ABABA"))


def _broadcast_joins(df):
    """The join keys of the broadcast joins that the plan would run."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line.split("BroadcastHashJoin ", 1)[1] for line in plan.splitlines() if "BroadcastHashJoin [" in line]


def test_windows_of_small_files_are_not_broadcast(spark, make_rows):
    rows = make_rows({f"s{i}": list("abcabcabd") for i in range(20)})
    chunks = sessions.session_chunks(sessions.with_positions(rows))
    written = stage(chunks, "chunks")  # a file of a few kB, whose windows take far more room
    wins = seqwin.next_event_windows(written, 2)
    model = NextEventModel.fit(wins.select("context", "next").distinct(), 2).staged()
    hits = model.hits(wins, 1)
    scored = seqwin.score_distinct(wins, "context", lambda d: d.withColumn("score", F.size("context")))
    counted = seqwin.count_vectors(wins, "context", seqwin.vocabulary(make_rows({"s": list("abcd")})), 4)
    for df in (hits, scored, counted):
        assert not [k for k in _broadcast_joins(df) if "context" in k or "suffix" in k]
        assert df.count() == 20 * 7
