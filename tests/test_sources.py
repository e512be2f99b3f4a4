import pytest

from emberlog.sources import readers, writers


def test_lines_are_numbered_across_files_and_splits(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    text = [f"line {i}" for i in range(5000)]
    for part in range(5):
        (folder / f"p{part}.log").write_text("\n".join(text[part * 1000 : part * 1000 + 1000]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = readers.read_lines(spark, str(folder)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["line_no"], r["value"]) for r in got] == [(i + 1, v) for i, v in enumerate(text)]


@pytest.mark.parametrize("limit", [1, 3, 5])
def test_many_splits_are_read_in_runs_of_files(spark, tmp_path, limit):
    """Above the broadcast limit: the same numbers, every broadcast bounded, and no text in a shuffle."""
    folder = tmp_path / "a b"
    folder.mkdir()
    text = []
    for k, n in enumerate((0, 70, 3, 250, 1, 40)):
        mine = [f"file {k} line {i} {'x' * (i % 30)}" for i in range(n)]
        (folder / f"{k} part.log").write_text("".join(v + "\n" for v in mine))
        text += mine
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = readers.read_lines(spark, str(folder), limit)
        plan = lines._jdf.queryExecution().executedPlan().toString()
        got = lines.orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [(r["line_no"], r["value"]) for r in got] == [(i + 1, v) for i, v in enumerate(text)]
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") > 3


def test_last_line_without_line_feed_is_whole(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo")
    lines = readers.read_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
    assert [r["value"] for r in lines] == ["one", "two"]


def test_instances_keep_awkward_text(spark, tmp_path):
    events = ["plain", "it's", 'say "x"', "a, b", "back\\slash"]
    df = spark.createDataFrame([("s", 0, events, 1), ("t", 0, [], 0)], "session_id string, chunk bigint, events array<string>, label int")
    path = str(tmp_path / "csv")
    writers.write_sessions(df, path, "csv")
    got = {r["session_id"]: (r["events"], r["label"]) for r in readers.read_instances(spark, path).collect()}
    assert got == {"s": (events, 1), "t": ([], 0)}


def test_python_list_cells(spark, tmp_path):
    (tmp_path / "i.csv").write_text('EventSequence,Label\n"[\'E1\', \'E2\']",1\n"[\'E3\']",0\n')
    got = readers.read_bare_instances(spark, str(tmp_path / "i.csv")).orderBy("row_no").collect()
    assert [(r["events"], r["label"]) for r in got] == [(["E1", "E2"], 1), (["E3"], 0)]


def test_structured_log_keeps_empty_cells(spark, tmp_path):
    header = "LineId,Date,Time,Pid,Level,Component,Content,EventId,EventTemplate,Arg0,Arg1,Arg2,Arg3"
    (tmp_path / "s.csv").write_text(f'{header}\n1,d,t,1,I,c,"NA, text",E1,tpl,a,,,\n2,d,t,1,I,c,other,,,,,,\n')
    got = readers.read_structured(spark, str(tmp_path / "s.csv")).orderBy("line_no").collect()
    assert [(r["content"], r["event_id"]) for r in got] == [("NA, text", "E1"), ("other", "")]


def test_wildcard_templates(spark, tmp_path):
    from emberlog.operators.parse import wildcard_patterns

    (tmp_path / "w.csv").write_text('EventTemplate\n"[x: <*>] done, (now)."\nplain <*>\n')
    table = wildcard_patterns(readers.read_wildcard_templates(spark, str(tmp_path / "w.csv")))
    got = [(r["idx"], r["pattern"]) for r in table.orderBy("idx").collect()]
    assert got == [(0, r"\[x: (.*)\] done, \(now\)\."), (1, "plain (.*)")]


def test_instances_without_chunk_column(spark, tmp_path):
    (tmp_path / "i.csv").write_text("BlockId,EventSequence,Label\nblk_1,\"['E1', 'E2']\",1\nblk_-2,\"['E3']\",0\n")
    got = {r["session_id"]: (r["chunk"], r["events"], r["label"]) for r in readers.read_instances(spark, str(tmp_path / "i.csv")).collect()}
    assert got == {"blk_1": (0, ["E1", "E2"], 1), "blk_-2": (0, ["E3"], 0)}


def test_rich_instances_in_any_column_order(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "BlockId,TimeSequence,PidSequence,extra,EventSequence,Label\nb,\"['t1', 't2']\",\"['7', '8']\",x,\"['E1', 'E2']\",1\n"
    )
    row = readers.read_rich_instances(spark, str(tmp_path / "r.csv")).first()
    assert (row["session_id"], row["events"], row["times"], row["pids"], row["label"]) == (
        "b", ["E1", "E2"], ["t1", "t2"], ["7", "8"], 1,
    )


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Label,BlockId\nAnomaly,blk_1\n")
    assert [tuple(r) for r in readers.read_labels(spark, str(tmp_path / "l.csv")).collect()] == [("blk_1", "Anomaly")]
    (tmp_path / "m.csv").write_text("Block,Label\nblk_1,Anomaly\n")
    with pytest.raises(ValueError, match="BlockId"):
        readers.read_labels(spark, str(tmp_path / "m.csv"))


def test_long_sessions_keep_their_chunks(spark, tmp_path):
    schema = "session_id string, chunk bigint, events array<string>, label int"
    whole = spark.createDataFrame([("s", 0, ["a"], 1)], schema)
    cut = spark.createDataFrame([("s", 0, ["a"], 1), ("s", 1, ["b"], 1)], schema)
    for name, df, header in (("w", whole, "BlockId,EventSequence,Label"), ("c", cut, "BlockId,Chunk,EventSequence,Label")):
        path = str(tmp_path / name)
        writers.write_sessions(df, path, "csv")
        assert spark.read.text(path).first()["value"] == header
        assert sorted(map(tuple, readers.read_instances(spark, path).collect())) == sorted(map(tuple, df.collect()))


def test_numbered_catalogue(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1.Receiving block (.*) src: 2.5 (.*) 2.Verified 3.x (.*) 3.Served (.*)\n")
    got = [(r["idx"], r["pattern"]) for r in readers.read_numbered_catalogue(spark, str(tmp_path / "c.txt")).orderBy("idx").collect()]
    assert got[0] == (0, "Receiving block (.*) src:") and len(got) >= 3


def test_too_many_arguments_are_an_error(spark):
    fields = "date time pid level component content event_id event_template".split()
    df = spark.createDataFrame(
        [(1, *["x"] * 8, list("abcde"))], "line_id bigint, " + ", ".join(f"{c} string" for c in fields) + ", args array<string>"
    )
    assert writers.hdfs_table(df, 5).first()["Arg4"] == "e"
    with pytest.raises(Exception, match="more arguments than columns"):
        writers.hdfs_table(df).collect()


def test_line_numbers_shuffle_no_text(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = readers.read_lines(spark, str(tmp_path / "a.log"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_outcome_dump_keeps_order(spark, tmp_path):
    rows = [(f"s{i}", 9 - i, 0, "tp" if i % 2 else "fn", f"text {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "session_id string, first_line bigint, chunk bigint, outcome string, text string")
    path = tmp_path / "out"
    writers.write_outcomes(df, str(path))
    lines = [x for f in sorted((path / "outcome=tp").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [f"text {i}" for i in (9, 7, 5, 3, 1)]
    assert readers.read_outcomes(spark, str(path)).where("outcome = 'fn'").count() == 5
