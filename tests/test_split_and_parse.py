import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.operators import parse, split
from emberlog.sources import readers


def heads(spark, labels):
    rows = [(f"s{i:03d}", i, 1, y) for i, y in enumerate(labels)]
    return spark.createDataFrame(rows, "session_id string, first_line bigint, n_events bigint, label int")


def parts(df):
    out = {"train": [], "validate": [], "test": []}
    for r in df.orderBy("session_id").collect():
        out[r["split"]].append(int(r["session_id"][1:]))
    return out


def test_uniform_two_way(spark):
    got = parts(split.split_uniform(heads(spark, [1, 0, 0, 1, 0]), 0.5))
    assert got == {"train": [0, 1], "validate": [], "test": [2, 3, 4]}


def test_sequential_three_way(spark):
    got = parts(split.split_sequential(heads(spark, [0] * 5), 0.4, 0.2, width=2))
    assert got == {"train": [0, 1], "validate": [2, 3], "test": [4]}


def test_balanced(spark):
    got = parts(split.split_uniform(heads(spark, [1] * 4 + [0] * 10), 0.5, 0.5, balanced=True, width=3))
    assert got["train"] == [0, 1, 4, 5]
    assert got["test"] == [2, 3, *range(6, 14)]
    assert got["validate"] == []


def test_overlapping_ratios_are_rejected(spark):
    with pytest.raises(ValueError):
        split.split_uniform(heads(spark, [0, 1]), 0.7, 0.6)


def test_zero_test_share_gives_an_empty_test_part(spark):
    assert parts(split.split_sequential(heads(spark, [0] * 3), 0.5, 0.1))["test"] == []


def test_unlabelled_sessions_split_sequentially(spark):
    got = parts(split.split_sessions(heads(spark, [None] * 4), 0.5, "uniform", labelled=False))
    assert got == {"train": [0, 1], "validate": [], "test": [2, 3]}


def test_index_split_defaults_to_the_rest(spark):
    got = split.split_index(heads(spark, [1, 0, 0, 1, 0]), 0.5).orderBy("row_idx").collect()
    # Both classes are cut by int(): one row of the larger class falls between the parts.
    assert [r["split"] for r in got] == ["train", "train", "validate", "test", "test"]


def test_shuffle_is_a_repeatable_permutation(spark):
    df = heads(spark, [0] * 50)
    first = {r["session_id"]: r["shuffle_no"] for r in split.shuffled(df, 3).collect()}
    assert sorted(first.values()) == list(range(50))
    assert first == {r["session_id"]: r["shuffle_no"] for r in split.shuffled(df.repartition(7), 3).collect()}
    assert first != {r["session_id"]: r["shuffle_no"] for r in split.shuffled(df, 4).collect()}


def test_summary_has_a_total_row(spark):
    rows = split.split_summary(split.split_uniform(heads(spark, [1, 0, 0, 1, 0]), 0.5)).collect()
    got = {r["split"]: (r["total"], r["anomaly"], r["normal"]) for r in rows}
    assert got == {"train": (2, 1, 1), "test": (3, 1, 2), "total": (5, 2, 3)}


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values, 1)), "line_no bigint, value string")


def catalogue(spark, *patterns):
    rows = [(i, p, [0]) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "idx int, pattern string, args_keep array<int>")


def test_hdfs_line(spark):
    df = parse.hdfs_fields(lines(spark, "081109 203615 148 INFO dfs.X: Receiving block blk_1 src: /a, dest: /b"))
    row = df.first()
    assert (row["date"], row["time"], row["pid"], row["level"]) == ("081109", "203615", "148", "INFO")
    assert (row["component"], row["content"]) == ("dfs.X", "Receiving block blk_1 src: /a")


def test_first_template_wins_and_matches_at_the_start_only(spark):
    fields = spark.createDataFrame(
        [(1, "Receiving block x src: y"), (2, "Receiving x"), (3, "not Receiving x"), (4, "Receiving x tail")],
        "line_no bigint, content string",
    )
    table = catalogue(spark, r"Receiving block (.*) src: (.*)", r"Receiving (\w)")
    got = {r["line_no"]: (r["idx"], r["args"]) for r in parse.match_templates(fields, table, True).collect()}
    assert got == {1: (0, ["x"]), 2: (1, ["x"]), 3: (None, []), 4: (1, ["x"])}


def test_long_catalogues_keep_their_order(spark):
    table = catalogue(spark, *[f"event {i}$" for i in range(120)], "event (.*)")
    fields = spark.createDataFrame(
        [(0, "event 7"), (1, "event 119"), (2, "event 500")], "line_no bigint, content string"
    )
    got = {r["line_no"]: r["event_id"] for r in parse.match_templates(fields, table).collect()}
    assert got == {0: "E7", 1: "E119", 2: "E120"}


def test_required_literals():
    cases = {
        r"Receiving block (.*) src: (.*)": [" src: ", "Receiving block "],
        r"a+bc?d\.e\d{2,3}f[x+]g(h|i)?$": ["b", "d.e", "f", "g"],
        r"one|two": [],
        r"(?i)abc": [],
        r"x(?:a\)b)y[^\]]z": ["x", "y", "z"],
        r".*": [],
        r"\[instance: (.*)\] done": ["[instance: ", "] done"],
        r"ab{2}c": ["a", "c"],
    }
    for pattern, want in cases.items():
        found = parse.required_literals(pattern)
        assert found == want or set(found) <= set(want), pattern


def test_a_thousand_templates(spark):
    """The first match in order, as without the prefilter; few regexes are left for each line."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé.[(") for _ in range(rng.randint(3, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(2, 7))) for _ in range(1_000)]
    patterns = [" ".join(rng.choice(["(.*)", r"\S+", re.escape(w)]) if k and rng.random() < 0.4 else re.escape(w) for k, w in enumerate(t.split(" "))) for t in texts]
    patterns[20:20] = ["(?i)A b", "q|a .*", "(.*) (.*) (.*) (.*) (.*) (.*) (.*)"]
    table = spark.createDataFrame([(3 * i, p, [0] if "(.*)" in p else []) for i, p in enumerate(patterns)], "idx int, pattern string, args_keep array<int>")
    rows = [(i, t) for i, t in enumerate(texts[::5] + [" ".join(word() for _ in range(4)) for _ in range(100)] + [None, ""])]
    fields = spark.createDataFrame(rows, "line_no bigint, content string")
    quick = {r.line_no: (r.idx, r.args) for r in parse.match_templates(fields, table, True).collect()}
    want = {}
    for i, t in rows:
        hit = next((k for k, p in enumerate(patterns) if t is not None and re.match(p, t)), None)
        first = [] if hit is None or "(.*)" not in patterns[hit] else [re.match(patterns[hit], t)[1]]
        want[i] = (None if hit is None else 3 * hit, first)
    assert quick == want and sum(k is not None for k, _ in want.values()) >= 200
    places = parse._candidates(patterns)
    left = fields.where("content is not null").select(F.avg(F.size(places("content"))).alias("n")).first()["n"]
    assert left < 10


def test_short_line_stops_or_is_skipped(spark):
    df = lines(spark, "a b c d e: f", "short line", "a b c d e: g")
    assert [r["line_no"] for r in parse.hdfs_until_short(df).collect()] == [1]
    assert sorted(r["line_no"] for r in parse.hdfs_until_short(df, "skip").collect()) == [1, 3]


def test_openstack_lines_are_numbered_without_gaps(spark):
    df = lines(
        spark,
        "api.log 2017-05-16 00:00:00 25746 INFO svc [req-1] [instance: q] VM Started",
        "too short",
        "api.log 2017-05-16 00:00:00 25746 INFO svc no bracket",
        "api.log 2017-05-16 00:00:00 25746 INFO svc [req-2] something else",
        "api.log 2017-05-16 00:00:00 25746 INFO svc [req-3] [instance: r] VM Started, twice",
    )
    table = parse.wildcard_patterns(
        spark.createDataFrame([(0, "[instance: <*>] VM Started")], "idx int, template string")
    )
    got = parse.structured_openstack(df, table).orderBy("line_id").collect()
    assert [(r["line_id"], r["line_no"], r["addr"]) for r in got] == [(1, 1, "req-1"), (2, 5, "req-3")]
    assert got[1]["content"] == "[instance: r] VM Started, twice"


def test_invalid_pattern_fails_at_load(spark, tmp_path):
    (tmp_path / "t.csv").write_text("idx,pattern,args_keep\n0,(unclosed,\n")
    with pytest.raises(ValueError):
        readers.read_templates(spark, str(tmp_path / "t.csv"))
