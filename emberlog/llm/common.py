"""Helpers shared by the corpus operators: text rules, row keys, ranks and running sums without one task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Rows that one task of a running sum should see at most (on average, for any group).
BUCKET_ROWS = 16_384


def text_or_empty(column: str = "text") -> Column:
    """The text as a string; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_row_key(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``row_id`` and ``row_hash``: rows that share both are taken to be repeated rows.

    The hash has 64 bits: a third of a large table may share one id or have none.
    """
    return docs.withColumns(
        {
            "row_id": F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))),
            "row_hash": F.xxhash64(text_or_empty(text)),
        }
    )


def packed_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the whole row as ``row``, so that no working column meets one of the user's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(columns: list[str], changed: dict[str, Column]) -> list[Column]:
    """The columns of ``row`` as they came, but for the changed ones."""
    return [changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns]


def bucket_count(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """A power of two of buckets so that ``rows`` spread evenly leave ``per_bucket`` in each."""
    buckets = 1
    while buckets * per_bucket < rows:
        buckets *= 2
    return buckets


def running_sum(
    df: DataFrame,
    group: list[str],
    bucket: str,
    order: list[Column],
    value: Column,
    name: str,
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that come before this one.

    ``bucket`` is a column that rises with ``order``. Sums per (group, bucket) are added up first, so
    no task ever holds a group: the window below runs inside one bucket of one group.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_start"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, same, "left")
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_start", *[f"_{k}" for k in keys])
    )
