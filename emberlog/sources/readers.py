"""Readers. Every schema is explicit; nothing is inferred by a second pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from emberlog.operators.parse import check_patterns
from emberlog.session import SMALL_ROWS, stage

# Column layouts of the file formats.
HDFS_COLUMNS = "LineId bigint, Date string, Time string, Pid string, Level string, Component string, " \
    "Content string, EventId string, EventTemplate string, Arg0 string, Arg1 string, Arg2 string, Arg3 string"
OPENSTACK_COLUMNS = "LineId bigint, Logrecord string, Date string, Time string, Pid string, Level string, " \
    "Component string, ADDR string, Content string, EventId string, EventTemplate string"
INSTANCE_COLUMNS = "BlockId string, Chunk bigint, EventSequence string, Label int"
RICH_COLUMNS = "BlockId string, Chunk bigint, EventSequence string, TimeSequence string, PidSequence string, Label int"


def _raw_lines(spark: SparkSession, path: str, between: tuple[str, str] | None = None) -> DataFrame:
    """Lines of all files, or of those with names in a range (other files are not opened)."""
    text = spark.read.text(path)
    if between is not None:
        text = text.where(F.col("_metadata.file_path").between(*between))
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )


def _file_slices(spark: SparkSession, path: str, limit: int) -> list[tuple[str, str]]:
    """First and last file of runs of files (in order) that are read as about ``limit`` splits at most.

    Sizes come from the file listing, no content is read; a run is at least one file.
    """
    files = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size")
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    slices, splits = [], 0
    for name, size in files.orderBy("file_path").toLocalIterator():
        mine = 1 + size // most
        if not slices or splits + mine > limit:
            slices.append((name, name))
            splits = 0
        slices[-1], splits = (slices[-1][0], name), splits + mine
    return slices


def read_lines(spark: SparkSession, path: str, broadcast_splits: int = SMALL_ROWS) -> DataFrame:
    """``line_no`` (1-based, in file order) and ``value``.

    Lines are counted per file split; a line's number is its place in the split plus the lines of all
    earlier splits. Only the table with one row per split is ordered and joined. It is broadcast, so no
    text is ever shuffled: more than ``broadcast_splits`` splits are read as several runs of files, each
    with its own part of the table.
    """
    slices = _file_slices(spark, path, broadcast_splits)
    if not slices:
        return _raw_lines(spark, path).select(F.lit(0).cast("bigint").alias("line_no"), "value")
    parts = [_raw_lines(spark, path, run if len(slices) > 1 else None) for run in slices]
    counted = None
    for number, part in enumerate(parts):
        found = part.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        found = found.withColumn("_part", F.lit(number))
        counted = found if counted is None else counted.unionByName(found)
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    # A file of its own may have more splits than one broadcast takes: its table comes in several pieces.
    piece = F.floor((F.row_number().over(Window.partitionBy("_part").orderBy("_file", "_start")) - 1) / F.lit(broadcast_splits))
    splits = stage(
        counted.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_piece", piece).drop("_n"),
        "splits",
    )
    pieces = {r["_part"]: r["n"] for r in splits.groupBy("_part").agg((F.max("_piece") + 1).alias("n")).collect()}
    place = F.col("_before") + F.col("_id") - F.col("_first") + 1
    out = None
    for number, part in enumerate(parts):
        for k in range(pieces.get(number, 0)):
            table = splits.where((F.col("_part") == number) & (F.col("_piece") == k)).select("_file", "_start", "_first", "_before")
            rows = part.join(F.broadcast(table), ["_file", "_start"]).select(place.alias("line_no"), "value")
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else _raw_lines(spark, path).select(F.lit(0).cast("bigint").alias("line_no"), "value")


def _csv(spark: SparkSession, path: str, schema: str, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """The columns of ``schema``, found by their names in the header, in any order and among others.

    A missing column is an error unless it has a default; files whose headers differ are an error.
    """
    reader = (
        spark.read.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", None)
    )
    header = reader.csv(path).columns
    text = StructType([StructField(name, StringType()) for name in header])
    table = reader.schema(text).option("enforceSchema", False).csv(path)
    defaults = defaults or {}
    columns = []
    for field in StructType.fromDDL(schema):
        if field.name in header:
            columns.append(F.col(f"`{field.name}`").cast(field.dataType).alias(field.name))
        elif field.name in defaults:
            columns.append(defaults[field.name].cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"no column {field.name} in {path}: {header}")
    return table.select(*columns)


def read_structured(spark: SparkSession, path: str, family: str = "hdfs") -> DataFrame:
    """``line_no, content, event_id`` of a structured log in CSV."""
    schema = {"hdfs": HDFS_COLUMNS, "openstack": OPENSTACK_COLUMNS}[family]
    wanted = [c for c in schema.split(", ") if c.split(" ")[0] in ("LineId", "Content", "EventId")]
    table = _csv(spark, path, ", ".join(wanted))
    return table.select(
        F.col("LineId").alias("line_no"),
        # Empty cells are empty text, never null.
        F.coalesce("Content", F.lit("")).alias("content"),
        F.coalesce("EventId", F.lit("")).alias("event_id"),
    )


def _list(cell: str) -> Column:
    """A list literal such as ``['E1', 'E2']``; quotes inside are backslash-escaped."""
    return F.from_json(cell, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, chunk, events, label`` from an instance CSV (one list literal per row).

    Without a ``Chunk`` column every row is a whole session.
    """
    table = _csv(spark, path, INSTANCE_COLUMNS, {"Chunk": F.lit(0)})
    return table.select(
        F.col("BlockId").alias("session_id"),
        F.col("Chunk").alias("chunk"),
        _list("EventSequence").alias("events"),
        F.col("Label").alias("label"),
    )


def read_rich_instances(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_instances``, with aligned ``times`` and ``pids``."""
    table = _csv(spark, path, RICH_COLUMNS, {"Chunk": F.lit(0)})
    return table.select(
        F.col("BlockId").alias("session_id"),
        F.col("Chunk").alias("chunk"),
        _list("EventSequence").alias("events"),
        _list("TimeSequence").alias("times"),
        _list("PidSequence").alias("pids"),
        F.col("Label").alias("label"),
    )


def read_bare_instances(spark: SparkSession, path: str) -> DataFrame:
    """``row_no, events, label`` from a two-column sequence CSV, numbered in file order."""
    lines = read_lines(spark, path)
    parsed = F.from_csv(
        "value", "EventSequence string, Label int", {"escape": '"', "quote": '"'}
    )
    rows = lines.where(F.col("line_no") > 1).select((F.col("line_no") - 2).alias("row_no"), parsed.alias("c"))
    return rows.select("row_no", _list("c.EventSequence").alias("events"), F.col("c.Label").alias("label"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``BlockId, Label``."""
    return _csv(spark, path, "BlockId string, Label string")


def read_anomaly_list(spark: SparkSession, path: str) -> DataFrame:
    """One anomalous session id per line, as ``value``."""
    return spark.read.text(path)


def read_numbered_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Ordered catalogue ``idx, pattern, args_keep`` from one line ``1.<regex> 2.<regex> ...``.

    A template ends at the first blank in front of the next number and a dot.
    """
    line = spark.read.text(path).where(F.trim("value") != "").orderBy(F.monotonically_increasing_id()).first()
    found, rest, number = [], (line["value"].strip() if line else ""), 1
    while rest.startswith(f"{number}."):
        body, mark, after = rest[len(f"{number}.") :].partition(f" {number + 1}.")
        found.append((number - 1, body.strip(), []))
        rest, number = (mark + after).strip(), number + 1
    return check_patterns(spark.createDataFrame(found, "idx int, pattern string, args_keep array<int>"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Ordered catalogue ``idx, pattern, args_keep``; every pattern is compiled once here."""
    table = _csv(spark, path, "idx int, pattern string, args_keep string")
    kept = F.transform(F.filter(F.split("args_keep", " "), lambda a: a != ""), lambda a: a.cast("int"))
    return check_patterns(table.select("idx", "pattern", kept.alias("args_keep")))


def read_wildcard_templates(spark: SparkSession, path: str) -> DataFrame:
    """``idx, template`` from a CSV with one ``EventTemplate`` column, in file order."""
    lines = read_lines(spark, path).where(F.col("line_no") > 1)
    cell = F.from_csv("value", "EventTemplate string", {"escape": '"', "quote": '"'})["EventTemplate"]
    return lines.select((F.col("line_no") - 2).cast("int").alias("idx"), cell.alias("template"))


def read_template_lookup(spark: SparkSession, path: str) -> DataFrame:
    """``EventId, EventTemplate``."""
    return _csv(spark, path, "EventId string, EventTemplate string")


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """``win, start_index, end_index`` from the two-column bounds file; the line is the window."""
    pair = F.split("value", ",")
    return read_lines(spark, path).select(
        (F.col("line_no") - 1).alias("win"),
        pair[0].cast("bigint").alias("start_index"),
        pair[1].cast("bigint").alias("end_index"),
    )


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """``outcome, value`` from an outcome dump folder."""
    return spark.read.text(path).select("outcome", "value")
