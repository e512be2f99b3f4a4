import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberlog.operators import order, seqwin, sessions


def test_rank_matches_sorting_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), line) for line in rng.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "g string, line bigint")
    got = order.rank_in_order(df, order.line_bucket("line", 64), ["line"], ["g"], "r", "n").collect()
    for g in "ab":
        lines = sorted(x for k, x in rows if k == g)
        assert sorted((r["line"], r["r"]) for r in got if r["g"] == g) == [(x, i) for i, x in enumerate(lines)]
        assert {r["n"] for r in got if r["g"] == g} == {len(lines)}


def test_rank_over_everything(spark):
    df = spark.range(1000).withColumn("line", F.col("id") * 3)
    got = order.rank_in_order(df, order.line_bucket("line", 100), ["line"], out="r").collect()
    assert all(r["r"] == r["id"] for r in got)


def test_running_sums(spark):
    rng = random.Random(2)
    values = {rng.random(): rng.randint(0, 5) for _ in range(500)}
    df = spark.createDataFrame(list(values.items()), "v double, c bigint")
    got = {r["v"]: (r["cum_c"], r["all_c"]) for r in order.running_sums(df, "v", ["c"], parts=16).collect()}
    total = 0
    for v in sorted(values):
        total += values[v]
        assert got[v] == (total, sum(values.values()))


@pytest.mark.parametrize("chunk_len,halo,width", [(4, 3, 4), (5, 2, 2), (8, 8, 3), (1024, 64, 4)])
def test_windows_over_chunks_equal_plain_windows(spark, make_rows, chunk_len, halo, width):
    rng = random.Random(3)
    plain = {f"s{i}": [rng.choice("ABC") for _ in range(n)] for i, n in enumerate([1, 3, 4, 5, 8, 9, 16, 17, 40])}
    rows = sessions.with_positions(make_rows(plain), width=16)
    chunks = sessions.session_chunks(rows, chunk_len=chunk_len, halo=halo)
    assert chunks.agg(F.max(F.size("events"))).first()[0] <= chunk_len + halo
    got = seqwin.windows(chunks, width, chunk_len, halo).collect()
    expected = [
        (s, j, tuple(e[j : j + width])) for s, e in plain.items() for j in range(len(e) - width + 1)
    ]
    assert sorted((r["session_id"], r["pos"], tuple(r["win"])) for r in got) == sorted(expected)


def test_chunk_values_stay_aligned(spark, make_rows):
    rows = make_rows({"a": list("ABCDEFG")}).withColumn("tag", F.concat(F.lit("t"), "event"))
    chunks = sessions.session_chunks(sessions.with_positions(rows), ("event", "tag"), chunk_len=3, halo=1)
    for r in chunks.collect():
        assert [f"t{e}" for e in r["events"]] == r["tags"]


def test_positions_come_back_from_chunks(spark, make_rows):
    plain = {"a": list("ABCDEFGHI"), "b": list("AB")}
    chunks = sessions.session_chunks(sessions.with_positions(make_rows(plain)), chunk_len=4, halo=3)
    got = sorted(map(tuple, seqwin.chunk_positions(chunks, 4).collect()))
    assert got == [(s, i, e) for s, events in plain.items() for i, e in enumerate(events)]


def test_halo_must_cover_the_window(spark, make_rows):
    chunks = sessions.session_chunks(sessions.with_positions(make_rows({"a": ["A", "B"]})), chunk_len=4, halo=1)
    with pytest.raises(ValueError):
        seqwin.windows(chunks, 3, 4, 1)


def test_session_ids(spark):
    lines = spark.createDataFrame(
        [(0, "Moved blk_1 to blk_1, blk_-2"), (1, "heartbeat")], "line_no bigint, content string"
    )
    assert sorted(
        r["session_id"] for r in sessions.block_rows(lines, "line_no").collect()
    ) == ["blk_-2", "blk_1"]
    a, b = "12345678-1234-1234-1234-123456789abc", "abcdefab-1234-1234-1234-123456789abc"
    lines = spark.createDataFrame([(0, f"x {a} y {b} z"), (1, "none")], "line_no bigint, content string")
    assert [r["session_id"] for r in sessions.uuid_rows(lines, "line_no").collect()] == [b]


def test_heads_and_order_of_appearance(spark, make_rows):
    heads = sessions.session_heads(make_rows({"b": ["A", "B"], "a": ["A"]}, {"a": 1}), "bad")
    got = {r["session_id"]: r for r in sessions.with_seq_no(heads, width=1).collect()}
    assert (got["b"]["seq_no"], got["b"]["n_events"], got["b"]["label"]) == (0, 2, 0)
    assert (got["a"]["seq_no"], got["a"]["n_events"], got["a"]["label"]) == (1, 1, 1)


def test_labels_from_table_and_list(spark, make_rows):
    heads = sessions.session_heads(make_rows({"a": ["A"], "b": ["A"]}))
    table = spark.createDataFrame([("a", "Anomaly"), ("b", "Normal"), ("c", "Anomaly")], "BlockId string, Label string")
    got = {r["session_id"]: r["label"] for r in sessions.label_from_table(heads, table).collect()}
    assert got == {"a": 1, "b": 0}
    with pytest.raises(PySparkException):
        sessions.label_from_table(heads, table.where("BlockId = 'a'")).collect()
    listed = spark.createDataFrame([("b",), ("b",), ("z",)], "value string")
    got = {r["session_id"]: r["label"] for r in sessions.label_from_list(heads, listed).collect()}
    assert got == {"a": 0, "b": 1}
