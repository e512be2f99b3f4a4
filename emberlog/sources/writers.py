"""Writers. Task-local files and the commit protocol take the place of appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: least number of argument columns of the structured table.
ARG_COLUMNS = 4


def _list_literal(items: str) -> Column:
    escaped = F.transform(
        items,
        lambda e: F.replace(F.replace(e, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")),
    )
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(escaped, "', '"), F.lit("']"))
    )


def _csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """``value`` as text, in the order of ``line_no`` across the written files."""
    lines.orderBy("line_no").select("value").write.text(path)


def hdfs_table(structured: DataFrame, arguments: int = ARG_COLUMNS) -> DataFrame:
    """The structured log's column layout; unused argument columns stay empty.

    ``arguments`` is the number of argument columns; a line with more of them is an error.
    """
    too_many = F.raise_error(F.concat(F.lit("more arguments than columns in line "), F.col("line_id").cast("string")))
    kept = F.when(F.size("args") > arguments, too_many.cast("array<string>")).otherwise(F.col("args"))
    args = [F.coalesce(F.get(kept, F.lit(i)), F.lit("")).alias(f"Arg{i}") for i in range(max(arguments, ARG_COLUMNS))]
    return structured.select(
        F.col("line_id").alias("LineId"),
        F.col("date").alias("Date"),
        F.col("time").alias("Time"),
        F.col("pid").alias("Pid"),
        F.col("level").alias("Level"),
        F.col("component").alias("Component"),
        F.col("content").alias("Content"),
        F.coalesce("event_id", F.lit("")).alias("EventId"),
        F.coalesce("event_template", F.lit("")).alias("EventTemplate"),
        *args,
    )


def openstack_table(structured: DataFrame) -> DataFrame:
    return structured.select(
        F.col("line_id").alias("LineId"),
        F.col("logrecord").alias("Logrecord"),
        F.col("date").alias("Date"),
        F.col("time").alias("Time"),
        F.col("pid").alias("Pid"),
        F.col("level").alias("Level"),
        F.col("component").alias("Component"),
        F.col("addr").alias("ADDR"),
        F.col("content").alias("Content"),
        F.col("event_id").alias("EventId"),
        F.col("event_template").alias("EventTemplate"),
    )


def write_structured(table: DataFrame, path: str, form: str = "parquet") -> None:
    if form == "csv":
        _csv(table, path)
    else:
        table.write.parquet(path)


def write_sessions(chunks: DataFrame, path: str, form: str = "parquet") -> None:
    """``session_id, chunk, events, label`` (and ``times, pids``): parquet arrays, or list literals in CSV.

    The CSV has a ``Chunk`` column only if some session takes more than one row.
    """
    if form == "parquet":
        chunks.write.parquet(path)
        return
    named = [F.col("session_id").alias("BlockId")]
    if not chunks.where(F.col("chunk") > 0).isEmpty():
        named.append(F.col("chunk").alias("Chunk"))
    lists = {"events": "EventSequence", "times": "TimeSequence", "pids": "PidSequence"}
    cells = [_list_literal(c).alias(name) for c, name in lists.items() if c in chunks.columns]
    _csv(chunks.select(*named, *cells, F.col("label").alias("Label")), path)


def write_labels(labels: DataFrame, path: str) -> None:
    _csv(labels.select("BlockId", "Label"), path)


def write_anomaly_list(ids: DataFrame, path: str) -> None:
    ids.select("value").write.text(path)


def write_templates(templates: DataFrame, path: str) -> None:
    kept = F.array_join(F.col("args_keep").cast("array<string>"), " ").alias("args_keep")
    _csv(templates.select("idx", "pattern", kept), path)


def write_template_lookup(table: DataFrame, path: str) -> None:
    _csv(table.select("EventId", "EventTemplate"), path)


def write_bounds(bounds: DataFrame, path: str) -> None:
    """Start and end index per line, in window order, without header."""
    bounds.orderBy("win").select(F.concat_ws(",", "start_index", "end_index").alias("value")).write.text(path)


def write_outcomes(rendered: DataFrame, path: str) -> None:
    """``text`` per bucket folder, in order of first appearance."""
    ordered = rendered.orderBy("outcome", "first_line", "session_id", "chunk")
    ordered.select("outcome", F.col("text").alias("value")).write.partitionBy("outcome").text(path)
