"""Removal of repeated word sequences with suffix automata of reference shards.

Which words go: each word covered by a window of ``length`` words that also starts anywhere else, in
the same or another text, judged on the input. The reference is every text, so it has no size bound
and is not broadcast: it is cut into shards by content-defined anchors (see ``anchors``), and the
candidate segments of the texts travel to the shard that can hold their matches. For each shard a
suffix automaton is built over its distinct segments; every segment is then streamed through it for
matching statistics, and the windows whose match is long enough and occurs at least twice are marked.

Defined results: a null text has no words; texts shorter than a window lose nothing; repeated rows
lose the same words. Other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import anchors
from emberlog.llm.common import WORD, text_or_empty, with_row_key

LENGTH = 35
GRAM = 8


class Automaton:
    """Suffix automaton of several sequences of integers; counts in how many places a match ends."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.count = [0]

    def _state(self, size: int, steps: dict[int, int], link: int, count: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.size.append(size)
        self.count.append(count)
        return len(self.size) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A copy of q for the matches that end p's with the symbol."""
        nxt, link, size = self.next, self.link, self.size
        copy = self._state(size[p] + 1, dict(nxt[q]), link[q], 0)
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, sequence: list[int]) -> None:
        nxt, link, size, count = self.next, self.link, self.size, self.count
        last = 0
        for symbol in sequence:
            q = nxt[last].get(symbol)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, q, symbol)
                count[last] += 1
                continue
            new = self._state(size[last] + 1, {}, 0, 1)
            p = last
            while p >= 0 and symbol not in nxt[p]:
                nxt[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][symbol]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, q, symbol)
            last = new

    def finish(self) -> None:
        """Adds counts up along the links, longest states first."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list[int], length: int) -> list[int]:
        """First places of windows of ``length`` symbols that the automaton knows from two places or more."""
        nxt, link, size, count = self.next, self.link, self.size, self.count
        state, matched, found = 0, 0, []
        for i, symbol in enumerate(sequence):
            while state and symbol not in nxt[state]:
                state = link[state]
                matched = size[state]
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                matched += 1
            # The state that stands for the last ``length`` symbols.
            while state > 0 and size[link[state]] >= length:
                state = link[state]
                matched = min(matched, size[state])
            if matched >= length and count[state] > 1:
                found.append(i - length + 1)
        return found


def repeated_starts(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each content (words joined by a blank), the first words of windows that occur elsewhere."""
    names: dict[bytes, int] = {}
    sequences = [[names.setdefault(w, len(names)) for w in x.split(b" ")] for x in contents]
    automaton = Automaton()
    for x in sequences:
        automaton.add(x)
    automaton.finish()
    return [np.array(automaton.repeated(x, length), dtype=np.int64) for x in sequences]


def _word_units():
    return lambda text: anchors.word_hashes(text.encode("utf-8", "surrogatepass"))


def _word_cut():
    def cut(text: str, at: list[tuple[int, int]]) -> list[bytes]:
        words = WORD.findall(text)
        return [" ".join(words[a:b]).encode("utf-8", "surrogatepass") for a, b in at]

    return cut


def _content_words(content: bytes) -> np.ndarray:
    return anchors.word_hashes(content)


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with ``row_id``, ``row_hash`` and ``spans`` (null where nothing repeats)."""
    spans = anchors.repeated_spans(
        docs, length, gram, _word_units, _word_cut, lambda c: repeated_starts(c, length), _content_words
    )
    return with_row_key(docs).join(spans, ["row_id", "row_hash"], "left")


REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id") -> DataFrame:
    """One row per document: its words, the removed ones and a hash of the rest joined by a blank."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for document, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = WORD.findall(text.as_py())
                kept, at, removed = [], 0, 0
                for low, high in anchors.covered(spans.as_py() or [], length, len(words)):
                    kept += words[at:low]
                    removed += high - low
                    at = high
                kept += words[at:]
                rest = " ".join(kept).encode("utf-8", "surrogatepass")
                rows.append((document.as_py(), len(words), removed, hashlib.sha256(rest).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, t)
                        for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    marked = with_spans(docs.select(F.col(id_column).alias("doc_id"), "text"), length, gram)
    return marked.select("doc_id", text_or_empty().alias("text"), "spans").mapInArrow(digest, REPORT)
