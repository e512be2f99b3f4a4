"""Removal of repeated byte strings by threshold-bounded expansion on a Burrows-Wheeler transform.

Which bytes go: each byte covered by a string of ``length`` bytes that also starts anywhere else, in
the same or another text, judged on the input. Candidates come from content-defined anchors (see
``anchors``), so equal strings meet in one task; there a suffix array and a Burrows-Wheeler transform
of the distinct candidate segments are built, and common prefixes are derived by increasing value.

Defined results: a null text is the empty text; texts shorter than ``length`` bytes lose nothing; a
removal that cuts through a character leaves bytes that may not be UTF-8 (``kept_bytes``), which the
text form repairs by also dropping the rest of a cut character. Repeated rows lose the same bytes (all
covered ones, so whole copies vanish). Other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import anchors
from emberlog.llm.common import packed_rows, text_or_empty, unpacked, with_row_key

LENGTH = 200
GRAM = 32
# Symbols (257 of them) that one number of 63 bits holds.
FIRST = 7


def suffix_order(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of (at least) their first ``length`` symbols, and each suffix's row.

    Symbols are bytes, and separators (256 and more, one at the end), which come before all bytes. The
    first ``FIRST`` symbols are sorted as one number; then the reach of the ranks doubles in each round,
    and only suffixes that agree with another one so far are sorted again.
    """
    n = len(symbols)
    places = np.arange(n)
    parts = symbols >= 256
    padded = np.append(np.where(parts, 0, symbols + 1), np.zeros(FIRST - 1, dtype=np.int64))
    key = np.zeros(n, dtype=np.int64)
    for k in range(FIRST):
        key = key * 257 + padded[k : n + k]
    stops = np.flatnonzero(parts)
    # No two separators are equal, so a suffix that soon meets one agrees with no other.
    alone = stops[np.searchsorted(stops, places)] - places < FIRST
    order = np.argsort(key, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = (key[order[1:]] != key[order[:-1]]) | alone[order[1:]]
    # A rank is the row of the first suffix that agrees.
    ranks = np.empty(n, dtype=np.int64)
    ranks[order] = np.maximum.accumulate(np.where(first, places, 0))
    rows, reach = np.flatnonzero(~(first & np.append(first[1:], True))), FIRST
    while reach < length and len(rows):
        group, follow = ranks[order[rows]], ranks[order[rows] + reach]
        by = np.argsort(group * n + follow)
        group, follow, order[rows] = group[by], follow[by], order[rows][by]
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        ranks[order[rows]] = rows[np.maximum.accumulate(np.where(first, places[: len(rows)], 0))]
        rows = rows[~(first & np.append(first[1:], True))]
        reach *= 2
    row = np.empty_like(order)
    row[order] = places
    return order, row


def long_boundaries(order: np.ndarray, row: np.ndarray, symbols: np.ndarray, length: int) -> np.ndarray:
    """Rows whose suffix shares ``length`` symbols or more with the suffix of the row above.

    Breadth first over the common prefix: a boundary between rows t - 1 and t is open at level l while
    the two suffixes may share l symbols. Extending an interval backward by a symbol maps the rows
    between the successors of t - 1 and t to this boundary, so it stays open at level l + 1 when both
    begin with the same symbol and every boundary between the successors was open at level l. Levels
    are taken in increasing order, closed boundaries are never looked at again, and level ``length``
    is the last.
    """
    n = len(order)
    after = np.append(row, -1)[order + 1]  # row of the suffix one symbol shorter; -1 at the end
    head = symbols[order]
    open_rows = np.arange(1, n)
    opened = np.zeros(n + 1, dtype=np.int32)
    low, high = after[:-1], after[1:]
    # The first level needs equal symbols and two successors.
    keep = (head[:-1] == head[1:]) & (low >= 0) & (high >= 0)
    open_rows, low, high = open_rows[keep], low[keep], high[keep]
    flags = np.zeros(n, dtype=np.int32)
    flags[open_rows] = 1
    for _ in range(1, length):
        if not len(open_rows):
            break
        np.cumsum(flags, out=opened[1:])
        # Boundaries low + 1 .. high must all be open.
        keep = opened[high + 1] - opened[low + 1] == high - low
        flags[open_rows[~keep]] = 0
        open_rows, low, high = open_rows[keep], low[keep], high[keep]
    return open_rows


def repeated_starts(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each content, the starts of strings of ``length`` bytes that occur elsewhere in the list."""
    sizes = np.array([len(x) for x in contents])
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(ends[-1], dtype=np.int64)
    inside = np.ones(ends[-1], dtype=bool)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(contents), dtype=np.uint8)
    symbols[ends - 1] = 256 + np.arange(len(contents))  # no two separators are equal
    order, row = suffix_order(symbols, length)
    rows = long_boundaries(order, row, symbols, length)
    marked = np.unique(np.concatenate([order[rows], order[rows - 1]]))
    begins = ends - sizes - 1
    cuts = np.searchsorted(marked, np.append(begins, ends[-1]))
    return [marked[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], begins, strict=True)]


def _byte_units():
    return lambda text: np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _byte_cut():
    def cut(text: str, at: list[tuple[int, int]]) -> list[bytes]:
        data = text.encode("utf-8", "surrogatepass")
        return [data[a:b] for a, b in at]

    return cut


def _content_bytes(content: bytes) -> np.ndarray:
    return np.frombuffer(content, dtype=np.uint8)


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with ``row_id``, ``row_hash`` and ``spans`` (null where nothing repeats)."""
    spans = anchors.repeated_spans(
        docs, length, gram, _byte_units, _byte_cut, lambda c: repeated_starts(c, length), _content_bytes
    )
    return with_row_key(docs).join(spans, ["row_id", "row_hash"], "left")


def remaining(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    """The bytes outside the removed runs."""
    parts, at = [], 0
    for low, high in removed:
        parts.append(data[at:low])
        at = high
    parts.append(data[at:])
    return b"".join(parts)


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id") -> DataFrame:
    """One row per document: its bytes, the removed ones and a hash of the rest."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for document, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                removed = anchors.covered(spans.as_py() or [], length, len(data))
                kept = remaining(data, removed)
                rows.append(
                    (document.as_py(), len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest())
                )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, t)
                        for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    marked = with_spans(docs.select(F.col(id_column).alias("doc_id"), "text"), length, gram)
    return marked.select("doc_id", text_or_empty().alias("text"), "spans").mapInArrow(digest, REPORT)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents without their repeated strings; columns as they came, ``n_chars`` kept true.

    A text of which nothing is left becomes the empty text.
    """
    marked = with_spans(packed_rows(docs), length, gram)

    @F.pandas_udf("string")
    def shorten(texts, spans):
        kept = []
        for text, found in zip(texts, spans, strict=True):
            if found is None or not len(found):
                kept.append(text)
                continue
            data = text.encode("utf-8", "surrogatepass")
            kept.append(remaining(data, anchors.covered(list(found), length, len(data))).decode("utf-8", "ignore"))
        return pd.Series(kept, dtype=object)

    changed = F.col("spans").isNotNull()
    shorter = F.when(changed, shorten(text_or_empty("row.text"), "spans")).otherwise(F.col("row.text"))
    shorter = marked.select("row", "spans", shorter.alias("shorter"))
    new = {"text": F.col("shorter")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("shorter")).otherwise(F.col("row.n_chars")).cast(kind)
    return shorter.select(*unpacked(docs.columns, new))
