"""Positions in a given order, without sorting everything in one task.

The order key is cut into buckets. Buckets are counted (partial aggregation), the
counts become offsets, and rows are numbered inside their bucket only. With a line
number as key and a fixed bucket width no bucket can hold more rows than it has lines
(times the ids on one line), however hot one session or label is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_BUCKET = 1 << 18


def line_bucket(key: str, width: int = LINE_BUCKET) -> Column:
    return F.floor(F.col(key) / F.lit(width)).cast("bigint")


def rank_in_order(
    df: DataFrame,
    bucket: Column,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    out: str = "rank",
    count_out: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within ``by`` (non-null columns).

    ``bucket`` must rise with the first order key. ``count_out`` adds the number of rows of
    the ``by`` group, which the bucket counts give for free.
    """
    by = list(by)
    keyed = df.select("*", bucket.alias("_bucket"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sized = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    wanted = [F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")]
    if count_out:
        wanted.append(F.sum("_rows").over(group).alias(count_out))
    offsets = sized.select(*by, "_bucket", *wanted)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = keyed.select("*", F.row_number().over(inside).alias("_in"))
    place = (F.col("_before") + F.col("_in") - 1).alias(out)
    extra = [count_out] if count_out else []
    return numbered.join(offsets, [*by, "_bucket"]).select(*df.columns, place, *extra)


def value_bucket(df: DataFrame, value: str, parts: int = 64) -> Column:
    """Bucket number by quantile bounds of ``value`` (rows should be distinct in it).

    The bounds only decide where a row is worked on, so their approximation never
    changes a result.
    """
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(value, shares, 10_000).alias("b")).first()
    bounds = sorted(set(row["b"] or []))
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(edges, lambda b: b < F.col(value)))


def running_sums(df: DataFrame, value: str, sums: Sequence[str], parts: int = 64) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows with the same or a smaller ``value``, and the
    total ``all_<c>``.

    ``df`` holds one row per distinct ``value``.
    """
    keyed = df.select("*", value_bucket(df, value, parts).alias("_bucket"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = keyed.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(everything).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    numbered = keyed.select("*", *[F.sum(c).over(inside).alias(f"_i_{c}") for c in sums])
    return numbered.join(offsets, "_bucket").select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
    )
