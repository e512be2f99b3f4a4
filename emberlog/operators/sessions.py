"""Sessions from log rows.

A session is kept as bounded *chunks*, never as one array: chunk ``k`` carries the
events at positions ``k*chunk_len ...`` plus a halo of the next ``halo`` events, so
every window that starts in a chunk can be cut there without another shuffle, and a
session that holds a third of all rows is spread over as many chunks as it needs.
Per-session facts (first line, length, label) live in a narrow *heads* table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.order import LINE_BUCKET, line_bucket, rank_in_order

# Id patterns of the two supported log families.
BLOCK_ID = r"(blk_-?\d+)"
UUID_ID = r".*([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}).*"

CHUNK_LEN = 1024
HALO = 64


def block_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """One row per distinct block id of a line: ``session_id`` plus ``keep``."""
    ids = F.array_distinct(F.regexp_extract_all("content", F.lit(BLOCK_ID), 1))
    return lines.select(F.explode(ids).alias("session_id"), *keep)


def uuid_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """One row per line that holds a uuid; the last one on the line counts."""
    found = F.regexp_extract("content", UUID_ID, 1)
    return lines.select(found.alias("session_id"), *keep).where(F.col("session_id") != "")


def with_positions(rows: DataFrame, width: int = LINE_BUCKET) -> DataFrame:
    """Add ``pos``, the 0-based place of a row in its session (by ``line_no``)."""
    return rank_in_order(rows, line_bucket("line_no", width), ["line_no"], ["session_id"], "pos")


def session_heads(rows: DataFrame, label: str | None = None) -> DataFrame:
    """``session_id, first_line, n_events, label`` — the label is the largest row label."""
    flag = F.max(label).cast("int") if label else F.lit(None).cast("int")
    return rows.groupBy("session_id").agg(
        F.min("line_no").alias("first_line"),
        F.count(F.lit(1)).alias("n_events"),
        flag.alias("label"),
    )


def with_seq_no(heads: DataFrame, width: int = LINE_BUCKET) -> DataFrame:
    """Add ``seq_no``: sessions in order of first appearance, ties by id."""
    return rank_in_order(heads, line_bucket("first_line", width), ["first_line", "session_id"], out="seq_no")


def session_chunks(
    positioned: DataFrame,
    values: tuple[str, ...] = ("event",),
    chunk_len: int = CHUNK_LEN,
    halo: int = HALO,
) -> DataFrame:
    """``session_id, chunk`` and one array per value column (``events`` for ``event``)."""
    if not 0 <= halo <= chunk_len:
        raise ValueError("halo must lie between 0 and chunk_len")
    own = F.floor(F.col("pos") / F.lit(chunk_len)).cast("bigint")
    in_halo = (own > 0) & (F.col("pos") % F.lit(chunk_len) < F.lit(halo))
    homes = F.when(in_halo, F.array(own, own - 1)).otherwise(F.array(own))
    rows = positioned.select("session_id", "pos", *values, F.explode(homes).alias("chunk"))
    packed = rows.groupBy("session_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("pos", *values))).alias("_rows")
    )
    return packed.select("session_id", "chunk", *[F.col(f"_rows.{v}").alias(f"{v}s") for v in values])


def label_from_table(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Label 1 where the label table says ``Anomaly``; a session without an entry is an error."""
    table = labels.select(F.col("BlockId").alias("session_id"), F.col("Label").alias("_mark"))
    missing = F.raise_error(F.concat(F.lit("no label for session "), F.col("session_id")))
    label = F.when(F.col("_mark").isNull(), missing.cast("int")).otherwise((F.col("_mark") == "Anomaly").cast("int"))
    return heads.drop("label").join(table, "session_id", "left").withColumn("label", label).drop("_mark")


def label_from_list(heads: DataFrame, anomalous: DataFrame) -> DataFrame:
    """Label 1 where the session id is in the list of anomalous ids."""
    listed = anomalous.select(F.col("value").alias("session_id")).distinct().withColumn("_hit", F.lit(1))
    return (
        heads.drop("label")
        .join(listed, "session_id", "left")
        .withColumn("label", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )
