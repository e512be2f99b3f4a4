"""Windows over session chunks. All of them are narrow: a chunk carries its halo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.sequences import PAD, dense_vector, pad_left, pad_right
from emberlog.operators.lookup import encoded, looked_up
from emberlog.operators.sessions import CHUNK_LEN, HALO


def vocabulary(rows: DataFrame, with_pad: bool = False) -> DataFrame:
    """``event, idx``: distinct events in binary string order (one row per symbol)."""
    from pyspark.sql import Window

    symbols = rows.select("event").distinct()
    if with_pad:
        symbols = symbols.union(rows.sparkSession.createDataFrame([(PAD,)], "event string")).distinct()
    place = F.row_number().over(Window.orderBy("event")) - 1
    return symbols.withColumn("idx", place.cast("bigint"))


def chunk_positions(chunks: DataFrame, chunk_len: int = CHUNK_LEN) -> DataFrame:
    """``session_id, pos, event`` back from chunks (without their halos)."""
    own = F.posexplode(F.slice("events", 1, chunk_len)).alias("_i", "event")
    return chunks.select("session_id", "chunk", own).select(
        "session_id", (F.col("chunk") * chunk_len + F.col("_i")).alias("pos"), "event"
    )


def padded_left(chunks: DataFrame, lower_bound: int, chunk_len: int = CHUNK_LEN) -> DataFrame:
    """Left-pad sessions shorter than ``lower_bound``; such a session is one chunk."""
    if lower_bound > chunk_len:
        raise ValueError("the padding bound must not exceed the chunk length")
    padded = F.when(F.col("chunk") == 0, pad_left(F.col("events"), lower_bound)).otherwise(F.col("events"))
    return chunks.withColumn("events", padded)


def fixed_length(chunks: DataFrame, length: int = 50, chunk_len: int = CHUNK_LEN) -> DataFrame:
    """First ``length`` events of each session, right-padded; one row per session."""
    if length > chunk_len:
        raise ValueError("the fixed length must not exceed the chunk length")
    return chunks.where(F.col("chunk") == 0).select(
        "session_id", pad_right(F.col("events"), length).alias("events")
    )


def windows(chunks: DataFrame, width: int, chunk_len: int = CHUNK_LEN, halo: int = HALO) -> DataFrame:
    """``session_id, pos, win``: every run of ``width`` consecutive events."""
    if width < 1 or width - 1 > halo:
        raise ValueError("the halo must cover a window")
    starts = F.least(F.lit(chunk_len), F.size("events") - F.lit(width - 1))
    cut = F.transform(F.sequence(F.lit(1), starts), lambda i: F.slice(F.col("events"), i, F.lit(width)))
    return (
        chunks.where(F.size("events") >= width)
        .select("session_id", "chunk", F.posexplode(cut).alias("_i", "win"))
        .select("session_id", (F.col("chunk") * chunk_len + F.col("_i")).alias("pos"), "win")
    )


def next_event_windows(chunks: DataFrame, h: int, chunk_len: int = CHUNK_LEN, halo: int = HALO) -> DataFrame:
    """``session_id, pos, context, next`` for every event that has ``h`` events before it."""
    return with_context(windows(chunks, h + 1, chunk_len, halo), h)


def with_context(wins: DataFrame, h: int) -> DataFrame:
    """Split windows of ``h + 1`` events into context and next event."""
    return wins.withColumn("context", F.slice("win", 1, h)).withColumn("next", F.element_at("win", -1)).drop("win")


def windows_per_session(heads: DataFrame, h: int, lower_bound: int = 0) -> DataFrame:
    """Number of width-``h`` windows of each (padded) session."""
    length = F.greatest(F.col("n_events"), F.lit(lower_bound))
    return heads.select("session_id", F.greatest(length - F.lit(h - 1), F.lit(0)).alias("n_windows"))


def indexed(rows: DataFrame, column: str, vocab: DataFrame, by: list[str]) -> DataFrame:
    """``column`` as vocabulary indexes, -1 where unknown; ``by`` tells the rows apart."""
    table = vocab.select("event", F.col("idx").cast("int").alias("value"))
    return encoded(rows, column, table, by, F.lit(-1))


def count_vectors(wins: DataFrame, column: str, vocab: DataFrame, size: int) -> DataFrame:
    """Windows plus ``counts``: how often each of ``size`` vocabulary events occurs in ``column``.

    Padding and unknown events are not counted. Each distinct window is counted once.
    """
    long = wins.select(column).distinct().select(column, F.explode(column).alias("event"))
    known = looked_up(long, vocab.where(F.col("event") != PAD), "event")
    per_symbol = known.groupBy(column, "idx").agg(F.count(F.lit(1)).cast("double").alias("x"))
    entry = F.when(F.col("idx").isNotNull(), F.struct("idx", "x"))
    once = per_symbol.groupBy(column).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    dense = once.select(column, dense_vector(F.col("_entries"), size).cast("array<int>").alias("counts"))
    return join_distinct(wins, dense, column)


def distinct_windows(wins: DataFrame, key: str = "win") -> DataFrame:
    """Distinct windows with ``weight``, the number of occurrences."""
    return wins.groupBy(key).agg(F.count(F.lit(1)).alias("weight"))


def join_distinct(wins: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Windows with the columns of ``found``, which has one row per distinct ``key``.

    Both sides are shuffled. Windows cut from a written table look as small as its files, whose few symbols
    pack well, so without the hint millions of them would be broadcast through the driver.
    """
    return wins.join(found.hint("merge"), key)


def score_distinct(wins: DataFrame, key: str, scorer) -> DataFrame:
    """Run ``scorer`` (DataFrame to DataFrame, keeping ``key``) once per distinct window."""
    return join_distinct(wins, scorer(wins.select(key).distinct()), key)


def sequence_prints(positioned: DataFrame) -> DataFrame:
    """Per session: length and a 128-bit print of the whole sequence, by partial aggregation."""
    spot = F.struct("pos", "event")
    return positioned.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.bit_xor(F.xxhash64(spot, F.lit(1))).alias("print_a"),
        F.bit_xor(F.xxhash64(F.lit(2), spot)).alias("print_b"),
        F.min("line_no").alias("first_line"),
    )


def distinct_sequences(positioned: DataFrame) -> DataFrame:
    """First session of every distinct event sequence, with ``weight``."""
    return (
        sequence_prints(positioned)
        .groupBy("n_events", "print_a", "print_b")
        .agg(
            F.min(F.struct("first_line", "session_id")).alias("_first"),
            F.count(F.lit(1)).alias("weight"),
        )
        .select("_first.session_id", "n_events", "weight")
    )
