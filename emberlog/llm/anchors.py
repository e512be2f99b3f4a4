"""Candidate segments for repeated strings: content-defined anchors.

A *window* is ``length`` consecutive units (bytes or words) of one text. Its anchor is the ``gram``-unit
string inside it with the least hash, leftmost first, so equal windows have equal anchors at the same
offset, wherever they occur. Consecutive windows with the same anchor make up a *segment*; each window
lies in exactly one segment. Two windows of one segment cannot be equal, as their anchors sit at
different offsets. So a window is repeated when it also occurs in another segment with the same anchor
(hash), and only segments whose anchor occurs at least twice need to be looked at.

Segments that are equal as a whole (the bulk: copies) are recognised by a print and counted once; all
their windows are repeated. The rest is settled by an exact search among the distinct segments of an
anchor (``search`` below): a suffix array for bytes, a suffix automaton for words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import text_or_empty, with_row_key
from emberlog.session import stage

MULTIPLIER = 0x9E3779B97F4A7C15
# Units of a text that are hashed at once; blocks overlap by a window.
BLOCK = 1 << 20
POSITION_BITS = 21


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash (modulo 2**64, then scrambled) of every run of ``gram`` units, a power of two."""
    width, power, value = 1, MULTIPLIER, units.astype(np.uint64)
    while width < gram:
        value = value[:-width] * np.uint64(power) + value[width:]
        power = power * power & (2**64 - 1)
        width *= 2
    return mix(value)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, print) of every segment of one text.

    ``units`` are integers; equal units are equal integers in every text.
    """
    found = []
    windows = len(units) - length + 1
    for low in range(0, max(windows, 0), BLOCK):
        part = units[low : low + BLOCK + length - 1]
        hashes = gram_hashes(part, gram)
        keyed = (hashes >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_min(keyed, length - gram + 1) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        counts = np.diff(np.concatenate([starts, [len(at)]]))
        found.append((hashes[at[starts]], starts + low, counts))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    anchor, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
    return anchor.view(np.int64), first, count, segment_prints(units, first, first + count + length - 1)


class _Powers:
    """Powers of the multiplier and of its inverse (modulo 2**64), kept for the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4_096)
            up = np.full(size, MULTIPLIER, dtype=np.uint64)
            down = np.full(size, pow(MULTIPLIER, -1, 2**64), dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


POWERS = _Powers()
# A random-looking number for every byte value.
BYTE_NUMBERS = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIER))


def run_prints(numbers: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit prints of numbers[start:end] for many runs: polynomials moved to a common place."""
    up, down = POWERS.first(len(numbers) + 1)
    sums = np.zeros(len(numbers) + 1, dtype=np.uint64)
    np.cumsum(numbers * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def segment_prints(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Prints of units[start:end] for many segments."""
    numbers = BYTE_NUMBERS[units] if units.dtype == np.uint8 else mix(units.astype(np.uint64))
    return run_prints(numbers, start, end).view(np.int64)


# The six ASCII characters that part words; in UTF-8 they are never part of another character.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text."""
    letters = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], IS_SPACE[letters], [True]])))
    return run_prints(BYTE_NUMBERS[letters], edges[::2], edges[1::2])


Units = Callable[[str], np.ndarray]
SEGMENTS = "row_id long, row_hash long, anchor long, print long, first int, windows int, times int"


def find_segments(keyed: DataFrame, units: Callable[[], Units], length: int, gram: int) -> DataFrame:
    """All segments of all texts; ``keyed`` has row_id, row_hash and text.

    Of equal segments of one text the first has their number as ``times``; the others have 0 and need
    not travel, as all their windows are repeated. So a text that repeats itself makes no hot anchor.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = units()
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            parts, size = [], 0
            for i, text in enumerate(batch.column(2)):
                anchor, first, windows, prints = segments(make(text.as_py()), length, gram)
                _, at, count = np.unique(prints, return_index=True, return_counts=True)
                times = np.zeros(len(prints), dtype=np.int32)
                times[at] = count
                parts.append((np.full(len(anchor), i), anchor, prints, first, windows, times))
                size += len(anchor)
                if size > 200_000:
                    yield _pack(parts, ids, hashes)
                    parts, size = [], 0
            if size:
                yield _pack(parts, ids, hashes)

    return keyed.select("row_id", "row_hash", "text").mapInArrow(cut, SEGMENTS)


def _pack(parts: list, ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    row, anchor, prints, first, windows, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    columns = [ids[row], hashes[row], anchor, prints, first.astype(np.int32), windows.astype(np.int32), times]
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in columns], names=["row_id", "row_hash", "anchor", "print", "first", "windows", "times"]
    )


# A search sees the distinct segments of whole anchors, this many units or a little more at once.
SEARCH_UNITS = 400_000
# Anchors with more distinct segments than this are settled window by window instead.
CROWD = 2_000

Cut = Callable[[str, list[tuple[int, int]]], list[bytes]]
Search = Callable[[list[bytes]], list[np.ndarray]]


def repeated_spans(
    docs: DataFrame,
    length: int,
    gram: int,
    units: Callable[[], Units],
    cut: Callable[[], Cut],
    search: Search,
    piece_units: Callable[[bytes], np.ndarray],
    crowd: int = CROWD,
) -> DataFrame:
    """(row_id, row_hash, spans): the runs of first units of repeated windows, for texts that have any.

    ``units`` makes the integers of a text, ``cut`` the content of parts of it as bytes, and ``search``
    gets such contents and returns, for each, the first units of windows that occur in another place.
    ``piece_units`` makes the integers of a content.
    """
    keyed = with_row_key(docs).select("row_id", "row_hash", text_or_empty().alias("text"))
    found = stage(find_segments(keyed, units, length, gram), "segments")
    window = F.struct(F.col("first").alias("low"), (F.col("first") + F.col("windows")).alias("high"))
    again = found.where("times = 0").select("row_id", "row_hash", window.alias("span"))

    travelling = found.where("times > 0")
    shared = travelling.groupBy("anchor").agg(F.sum("times").alias("_n")).where("_n > 1").select("anchor")
    candidates = stage(travelling.join(shared, "anchor"), "candidates")
    prints = candidates.groupBy("anchor", "print").agg(
        F.sum("times").alias("n"), F.min(F.struct("row_id", "row_hash", "first", "windows")).alias("one")
    )
    prints = stage(prints.select("anchor", "print", "n", "one.*"), "distinct-segments")
    copied = (
        candidates.select("anchor", "print", "row_id", "row_hash", window.alias("span"))
        .join(prints.where("n > 1").select("anchor", "print"), ["anchor", "print"])
        .select("row_id", "row_hash", "span")
    )
    # Anchors with one distinct segment are settled by its print.
    sizes = prints.groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1")
    pieces = stage(_contents(keyed, prints.join(sizes, "anchor"), length, cut), "segment-contents")
    small = pieces.where(F.col("members") <= crowd)
    # Hash partitions of whole anchors, each anchor's rows together.
    dealt = small.repartition("anchor").sortWithinPartitions("anchor")
    partial = dealt.mapInArrow(_searcher(search, length), SPAN)
    crowded = _by_window(pieces.where(F.col("members") > crowd), length, piece_units)
    spans = again.unionByName(copied).unionByName(partial.select("row_id", "row_hash", "span")).unionByName(crowded)
    # Repeated rows have the same spans; a set keeps them once.
    return spans.groupBy("row_id", "row_hash").agg(F.collect_set("span").alias("spans"))


SPAN = "row_id long, row_hash long, span struct<low: int, high: int>"
CONTENT = "anchor long, members long, n long, row_id long, row_hash long, first int, content binary"


def _contents(keyed: DataFrame, prints: DataFrame, length: int, cut: Callable[[], Cut]) -> DataFrame:
    """The content of the chosen segments; each text is visited once for all of its segments.

    Repeated rows lie next to each other behind the merge join, and only the first of them is cut: a
    text that a third of all rows have must not send its segments as often.
    """
    wanted = prints.groupBy("row_id", "row_hash").agg(
        F.collect_list(F.struct("anchor", "members", "n", "first", "windows")).alias("parts")
    )
    joined = keyed.join(wanted.hint("merge"), ["row_id", "row_hash"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, last = cut(), None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if (row["row_id"], row["row_hash"]) == last:
                    continue
                last = row["row_id"], row["row_hash"]
                at = [(p["first"], p["first"] + p["windows"] + length - 1) for p in row["parts"]]
                for p, content in zip(row["parts"], make(row["text"], at), strict=True):
                    rows.append((p["anchor"], p["members"], p["n"], row["row_id"], row["row_hash"], p["first"], content))
                if len(rows) > 20_000:
                    yield _content_batch(rows)
                    rows = []
            if rows:
                yield _content_batch(rows)

    return joined.select("row_id", "row_hash", "text", "parts").mapInArrow(take, CONTENT)


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    names = ["anchor", "members", "n", "row_id", "row_hash", "first", "content"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted integers as half-open runs."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    lows = starts[np.concatenate([[0], breaks + 1])]
    highs = starts[np.concatenate([breaks, [len(starts) - 1]])] + 1
    return list(zip(lows.tolist(), highs.tolist(), strict=True))


def _searcher(search: Search, length: int):
    """Feeds whole anchors to the search, many at a time; contents that occur twice need no answer."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for row, starts in zip(rows, search([r[-1] for r in rows]), strict=True):
            if row[1] == 1:
                out += [(row[2], row[3], {"low": row[4] + a, "high": row[4] + b}) for a, b in runs(starts)]
        arrays = zip(*out, strict=True) if out else ([], [], [])
        types = [pa.int64(), pa.int64(), pa.struct([("low", pa.int32()), ("high", pa.int32())])]
        return pa.RecordBatch.from_arrays(
            [pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names=["row_id", "row_hash", "span"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("anchor", "n", "row_id", "row_hash", "first", "content")]
            for row in zip(*columns, strict=True):
                if size > SEARCH_UNITS and row[0] != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                last = row[0]
                size += len(row[-1])
        if held:
            yield settle(held)

    return work


def _by_window(pieces: DataFrame, length: int, piece_units: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Spans of crowded anchors: every window is a row, and windows with an equal print are counted.

    The counting is a partial aggregation, so any number of segments may share the anchor.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                units = piece_units(row["content"])
                at = np.arange(len(units) - length + 1)
                prints = segment_prints(units, at, at + length)
                kinds = {"anchor": np.int64, "row_id": np.int64, "row_hash": np.int64}
                same = [np.full(len(at), row[k], dtype=kind) for k, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, same), pa.array((row["first"] + at).astype(np.int32)), pa.array(prints)],
                    names=["anchor", "row_id", "row_hash", "low", "window"],
                )

    schema = "anchor long, row_id long, row_hash long, low int, window long"
    windows = pieces.mapInArrow(expand, schema)
    often = windows.groupBy("anchor", "window").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # A window keeps its one row or loses it, however many others are equal to it.
    return windows.join(often, ["anchor", "window"], "left_semi").select(
        "row_id", "row_hash", F.struct("low", (F.col("low") + 1).alias("high")).alias("span")
    )


def covered(spans: list[dict], length: int, total: int) -> list[tuple[int, int]]:
    """The maximal runs of units that repeated windows cover."""
    change = sorted((s["low"], s["high"] + length - 1) for s in spans)
    merged: list[list[int]] = []
    for low, high in change:
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return [(low, min(high, total)) for low, high in merged]
