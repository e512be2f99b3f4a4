"""Packing token sequences by cutting stock with column generation.

Documents are tokenised, and every full run of ``capacity`` tokens is a sequence of its own. The rests
are packed: a linear program over patterns (how many rests of each length class fill one sequence) is
solved by column generation, where a knapsack dynamic program over the dual prices finds the next
pattern. The solution is rounded down; its patterns are filled with the rests of each length in their
rank order. Rests that rounding leaves over, and those of patterns that would waste more than
``max_waste``, are strung together and cut into full sequences; the tail of that string is cut into
powers of two, which are not padded. So padding is what good patterns waste, below one percent.

Only the histogram of lengths (at most ``capacity`` rows) and the patterns (at most one for each length
class) reach the driver. Ranks within a length come from bucketed running sums, so a length with a
third of all documents is spread over many tasks.

Defined results: a null text is the empty text and has the end id alone. Repeated rows are packed each
on its own. An empty table gives no pieces. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import tokens
from emberlog.llm.common import bucket_count, running_sum, text_or_empty
from emberlog.session import stage

CAPACITY = 2_048
# Sequences of full runs are numbered from here: the document's place, then the run.
FULL_BASE = 1 << 61
RUN_BITS = 24


def price(values: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how many items of each width, by an unbounded knapsack."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    ends = np.searchsorted(widths, np.arange(capacity + 1), side="right").tolist()
    for room in range(int(widths[0]), capacity + 1):
        gains = values[: ends[room]] + best[room - widths[: ends[room]]]
        k = int(gains.argmax())
        best[room] = best[room - 1]
        if gains[k] > best[room] + 1e-12:
            best[room], choice[room] = gains[k], k
    pattern = np.zeros(len(widths), dtype=np.int64)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(widths[choice[room]])
    return float(best[capacity]), pattern


def cutting_stock(widths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, with the demand met exactly (not yet integer).

    Revised simplex; stops when no pattern helps, or within ``gap`` of a bound: the demand's total width
    over the capacity, or the bound from the best pattern's value.
    """
    m = len(widths)
    patterns = np.diag(capacity // widths).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // widths))
    amounts = inverse @ demand
    least = float(widths @ demand) / capacity
    for _ in range(20 * m):
        duals = inverse.sum(axis=0)
        value, column = price(np.maximum(duals, 0.0), widths, capacity)
        total = amounts.sum()
        if value <= 1 + 1e-9 or total - max(total / value, least) <= gap * total:
            break
        direction = inverse @ column
        steps = np.full(m, np.inf)
        up = direction > 1e-9
        steps[up] = amounts[up] / direction[up]
        leave = int(np.argmin(steps))
        amounts -= steps[leave] * direction
        amounts[leave] = steps[leave]
        amounts = np.maximum(amounts, 0.0)
        patterns[:, leave] = column
        inverse[leave] /= direction[leave]
        others = direction.copy()
        others[leave] = 0.0
        inverse -= np.outer(others, inverse[leave])
    return patterns, amounts


@dataclass
class Plan:
    """Where each rest goes, by its length and its rank among the rests of that length."""

    capacity: int
    sequence_base: dict[int, np.ndarray]  # class -> first sequence of each run of slots
    each: dict[int, np.ndarray]  # class -> slots of the class in one sequence of the run
    ends: dict[int, np.ndarray]  # class -> end of each run of slots
    before: np.ndarray  # length -> rests of the same class and a smaller length
    open: np.ndarray  # length -> first rank that goes into the string
    string_base: np.ndarray  # length -> place in the string of that first rank
    string_sequence: int  # sequence of the string's first token
    string_size: int
    width: int
    row_base: np.ndarray  # length -> documents with a smaller rest

    def slot(self, length: int, rank: int) -> tuple[int, int] | None:
        """(sequence, order in it) of a rest that fills a pattern."""
        kind = -(-length // self.width)
        if rank >= self.open[length]:
            return None
        place = int(self.before[length]) + rank
        k = int(np.searchsorted(self.ends[kind], place, side="right"))
        start = int(self.ends[kind][k - 1]) if k else 0
        return int(self.sequence_base[kind][k]) + (place - start) // int(self.each[kind][k]), kind

    def string_cuts(self, low: int, high: int) -> list[tuple[int, int, int]]:
        """(sequence, low, high) of the parts of [low, high) of the string."""
        out = []
        full = self.string_size // self.capacity
        while low < high:
            number = low // self.capacity
            end = (number + 1) * self.capacity
            if number >= full:  # the tail: powers of two, largest first
                rest, start, number = self.string_size - full * self.capacity, full * self.capacity, full
                while True:
                    part = 1 << (rest.bit_length() - 1)
                    if low < start + part:
                        break
                    start, rest, number = start + part, rest - part, number + 1
                end = start + part
            out.append((self.string_sequence + number, low, min(end, high)))
            low = min(end, high)
        return out


def plan(histogram: np.ndarray, capacity: int = CAPACITY, width: int = 8, max_waste: float = 0.01) -> Plan:
    """The plan for ``histogram[length]`` rests of each length below the capacity (length 0: no rest)."""
    lengths = np.arange(capacity)
    kinds = -(-lengths // width)
    demand = np.bincount(kinds, weights=np.where(lengths > 0, histogram, 0), minlength=capacity // width + 1)
    used = np.flatnonzero(demand)
    placed: dict[int, list[tuple[int, int, int]]] = {int(k): [] for k in used}
    sequences = 0
    if len(used):
        room = capacity // width
        patterns, amounts = cutting_stock(used, demand[used], room)
        for column, times in zip(patterns.T, np.floor(amounts + 1e-9).astype(np.int64), strict=True):
            if times and room - int(column @ used) <= max_waste * room:
                for k in np.flatnonzero(column):
                    placed[int(used[k])].append((sequences, int(column[k]), int(column[k] * times)))
                sequences += int(times)
    before, opened = np.zeros(capacity, np.int64), np.zeros(capacity, np.int64)
    for kind in used:
        slots, seen = sum(n for _, _, n in placed[int(kind)]), 0
        for length in lengths[(kinds == kind) & (lengths > 0)]:
            before[length] = seen
            opened[length] = min(max(slots - seen, 0), histogram[length])
            seen += int(histogram[length])
    left = np.where(lengths > 0, (histogram - opened) * lengths, 0)
    return Plan(
        capacity=capacity,
        sequence_base={k: np.array([s for s, _, _ in v]) for k, v in placed.items()},
        each={k: np.array([a for _, a, _ in v]) for k, v in placed.items()},
        ends={k: np.cumsum([n for _, _, n in v]) for k, v in placed.items()},
        before=before,
        open=opened,
        string_base=np.concatenate([[0], np.cumsum(left)[:-1]]),
        string_sequence=sequences,
        string_size=int(left.sum()),
        width=width,
        row_base=np.concatenate([[0], np.cumsum(histogram)[:-1]]).astype(np.int64),
    )


def pieces_of(count: int, rank: int, p: Plan) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, order in it) of the pieces of a document of ``count`` tokens."""
    runs, rest = divmod(count, p.capacity)
    row = int(p.row_base[rest]) + rank
    out = [(i * p.capacity, p.capacity, FULL_BASE + (row << RUN_BITS) + i, 0) for i in range(runs)]
    if rest:
        start = runs * p.capacity
        if (slot := p.slot(rest, rank)) is not None:
            out.append((start, rest, slot[0], slot[1]))
        else:
            low = int(p.string_base[rest]) + (rank - int(p.open[rest])) * rest
            for sequence, a, b in p.string_cuts(low, low + rest):
                out.append((start + a - low, b - a, sequence, a))
    return out


TOKENS = "doc_id long, row_hash long, n_tokens long, rest int, ids binary"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_column: str) -> DataFrame:
    """(doc_id, row_hash, n_tokens, rest, ids): the packed ids of every text and the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        end = end_id.to_bytes(encoder.dtype.itemsize, "little")
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                ids = [encoder.encode(x.as_py()) + end for x in part.column(2)]
                counts = np.array([len(x) // encoder.dtype.itemsize for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(counts),
                        pa.array((counts % capacity).astype(np.int32)),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "row_hash", "n_tokens", "rest", "ids"],
                )

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("row_hash"), text_or_empty().alias("text")
    )
    return slim.mapInArrow(encode, TOKENS)


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long, piece long"
)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    encoded = stage(tokenised(docs, tokenizer, end_id, capacity, id_column), "pack-tokens")
    histogram = np.zeros(capacity, dtype=np.int64)
    for rest, count in encoded.groupBy("rest").count().collect():  # at most ``capacity`` rows
        histogram[rest] = count
    where = plan(histogram, capacity)
    buckets = bucket_count(int(histogram.sum()))
    bucketed = encoded.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(buckets)))
    order = [F.col("doc_id"), F.col("row_hash")]
    ranked = running_sum(bucketed, ["rest"], "_bucket", order, F.lit(1), "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for document, count, rank, ids in zip(*(batch.column(i) for i in range(4)), strict=True):
                document, count, rank = document.as_py(), count.as_py(), rank.as_py()
                packed = ids.as_buffer()
                values = np.frombuffer(packed, dtype=f"<u{packed.size // count}").astype("<u4")
                for start, length, sequence, order_ in pieces_of(count, rank, where):
                    total = zlib.crc32(values[start : start + length].tobytes())
                    rows.append((document, start, length, total, count, sequence, order_, rank))
            columns = zip(*rows, strict=True) if rows else ([] for _ in range(8))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    pieces = ranked.select("doc_id", "n_tokens", "rank", "ids").mapInArrow(place, PIECES)
    # A sequence holds at most ``capacity`` pieces.
    inside = Window.partitionBy("sequence_id").orderBy("place", "piece", "doc_id", "start")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("place", "piece")
