"""Dictionary look-ups: a table with a row per symbol meets rows whose symbols are skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import SMALL_ROWS

# Parts into which the rows of every symbol are cut when the dictionary cannot be broadcast.
SALTS = 32


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "left", limit: int = SMALL_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``key``.

    A table of at most ``limit`` rows is broadcast, so rows stay where they are. A larger one is repeated
    for each of ``SALTS`` parts of the rows: then a symbol that holds a third of all rows is spread too.
    """
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", part).join(salted, [key, "_salt"], how).drop("_salt")


def encoded(
    rows: DataFrame, column: str, table: DataFrame, by: Sequence[str], unknown: Column, limit: int = SMALL_ROWS
) -> DataFrame:
    """``rows`` with the array ``column`` of symbols replaced by what ``table`` (``event``, ``value``) has for them.

    ``by`` names columns that tell the rows apart. Symbols are unpacked, looked up and packed again in
    their order; ``unknown`` stands for a symbol without a value and may use the column ``event``.
    """
    by = list(by)
    long = rows.select(*by, F.posexplode(column).alias("_at", "event"))
    found = looked_up(long, table.select("event", "value"), "event", limit=limit)
    spot = F.struct(F.col("_at"), F.coalesce("value", unknown).alias("v"))
    packed = found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(spot)), lambda s: s["v"]).alias("_packed"))
    kind = packed.schema["_packed"].dataType
    out = F.coalesce("_packed", F.array().cast(kind)).alias(column)
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest).join(packed, by, "left").select(*[out if c == column else c for c in rows.columns])
