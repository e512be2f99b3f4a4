"""Cheapest repair of role sequences: Re-Pair grammars, min-plus transfer matrices, audit ropes.

A row of a conversation is one of 16 symbols: the class of its role (system, user, assistant, other) and
its fault (none, blank, duplicate, truncated). A repair reads the rows from left to right and moves
between four states (nothing written yet, after system, after user, after assistant); what a run of rows
can do is a 4 x 4 matrix of the least cost from state to state, each with the least edit string of that
cost. Matrices of neighbouring runs multiply in the min-plus sense.

``Grammar`` replaces the pair of symbols that is met most often by a new symbol, again and again (Re-Pair).
The matrix of every rule is computed once, from the matrices of its two sides, and shared by all sequences
in which the rule stands. Edit strings are ropes: a rule's strings point to those of its sides, so a rule
costs the same however many rows it spans.

Of equal costs the string that is first in ASCII order is kept. That commutes with multiplying: strings
that edit the same rows at the same cost have as many insertions, so none is a proper prefix of another.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

CLASSES = "suao"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
SYMBOLS = 4 * len(CLASSES)
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED_EXTRA = 1
# Role pairs that may stand next to each other in a whole conversation.
LEGAL = {"su", "ua", "au"}
# Rules of one grammar; what is left after them is multiplied symbol by symbol.
MAX_RULES = 192
_PRIME, _BASE = (1 << 61) - 1, 0x1F3A5C7E9


class Rope:
    """A string made of two others, or a short one; equal ropes have equal prints."""

    __slots__ = ("left", "length", "print", "right", "scale", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.length, self.scale, self.print = len(text), pow(_BASE, len(text), _PRIME), 0
            for c in text:
                self.print = (self.print * _BASE + ord(c)) % _PRIME
        else:
            self.length = left.length + right.length
            self.scale = left.scale * right.scale % _PRIME
            self.print = (left.print * right.scale + right.print) % _PRIME

    def __add__(self, other: Rope) -> Rope:
        if not self.length:
            return other
        if not other.length:
            return self
        if self.length + other.length <= 16:
            return Rope(str(self) + str(other))
        return Rope("", self, other)

    def __str__(self) -> str:
        if self.left is None:
            return self.text
        out, open_ = [], [self]
        while open_:
            node = open_.pop()
            if node.left is None:
                out.append(node.text)
            else:
                open_ += (node.right, node.left)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """ASCII order; parts that are the same are passed over as a whole."""
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a is b or (a.length == b.length and a.print == b.print):
                continue
            if a.left is not None and (b.left is None or a.length >= b.length):
                mine += (a.right, a.left)
                theirs.append(b)
            elif b.left is not None:
                theirs += (b.right, b.left)
                mine.append(a)
            else:
                n = min(a.length, b.length)
                if a.text[:n] != b.text[:n]:
                    return a.text[:n] < b.text[:n]
                if a.length > n:
                    mine.append(Rope(a.text[n:]))
                if b.length > n:
                    theirs.append(Rope(b.text[n:]))
        return bool(theirs)


# An entry is (cost, rope) or None where there is no way.
Entry = tuple[int, Rope] | None
_EMPTY = Rope()
_AFTER_USER = (START, SYSTEM, ASSISTANT)


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def _step(state: int, role: str) -> int | None:
    """The state after a role is written, if it may be written."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state in _AFTER_USER else None
    return ASSISTANT if role == "a" and state == USER else None


def _inserted(state: int) -> list[tuple[int, int]]:
    """(number of insertions, state after them): more than three only lead in a circle."""
    ways = [(0, state)]
    for n in range(1, 4):
        state = ASSISTANT if state == USER else USER
        ways.append((n, state))
    return ways


class Run:
    """What is known of a run of rows: its matrix, fault counts, illegal neighbours and outer roles."""

    __slots__ = ("counts", "first", "illegal", "last", "matrix")

    def __init__(self, matrix: list[list[Entry]], counts: tuple, illegal: int, first: str, last: str):
        self.matrix, self.counts, self.illegal, self.first, self.last = matrix, counts, illegal, first, last

    def __mul__(self, other: Run) -> Run:
        return Run(
            [times(row, other.matrix) for row in self.matrix],
            tuple(a + b for a, b in zip(self.counts, other.counts)),
            self.illegal + other.illegal + (self.last + other.first not in LEGAL),
            self.first,
            other.last,
        )


def times(row: list[Entry], matrix: list[list[Entry]]) -> list[Entry]:
    """Min-plus product of a row of entries and a matrix."""
    out: list[Entry] = [None] * STATES
    for entry, ways in zip(row, matrix):
        if entry is None:
            continue
        for state, way in enumerate(ways):
            if way is not None:
                have, cost = out[state], entry[0] + way[0]
                if have is None or cost <= have[0]:
                    out[state] = better(have, (cost, entry[1] + way[1]))
    return out


def _terminal(symbol: int) -> Run:
    role, fault = CLASSES[symbol // 4], symbol % 4
    matrix: list[list[Entry]] = [[None] * STATES for _ in range(STATES)]
    for before in range(STATES):
        for n, state in _inserted(before):
            edits = [("D", DELETE, state)]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED_EXTRA if fault == TRUNCATED else 0
                edits += [("K", KEEP + extra, _step(state, role))]
                edits += [("R", REROLE + extra, _step(state, to)) for to in "ua"]
            for letter, cost, after in edits:
                if after is not None:
                    way = (INSERT * n + cost, Rope("I" * n + letter))
                    matrix[before][after] = better(matrix[before][after], way)
    counts = tuple(int(fault == f) for f in (BLANK, DUPLICATE, TRUNCATED))
    return Run(matrix, counts, 0, role, role)


TERMINALS = [_terminal(s) for s in range(SYMBOLS)]
FRESH: list[Entry] = [(0, _EMPTY), None, None, None]


def finished(row: list[Entry]) -> tuple[int, Rope]:
    """The cheapest end: nothing written, or after an assistant, with insertions at the end."""
    best = row[START]
    for state, entry in enumerate(row):
        if entry is not None:
            for n, after in _inserted(state):
                if after == ASSISTANT:
                    best = better(best, (entry[0] + INSERT * n, entry[1] + Rope("I" * n)))
    return best


class Grammar:
    """Re-Pair over several sequences; ``runs[symbol]`` is what a symbol stands for."""

    def __init__(self, sequences: Iterable[bytes], max_rules: int = MAX_RULES):
        arrays = [np.frombuffer(s, dtype=np.uint8).astype(np.int64) for s in sequences]
        self.runs = list(TERMINALS)
        self.rules: list[tuple[int, int]] = []
        width = SYMBOLS + max_rules
        gap = np.full(1, -1)
        flat = np.concatenate([part for a in arrays for part in (a, gap)]) if arrays else gap
        spent = np.zeros(width * width, dtype=bool)
        while len(self.rules) < max_rules and len(flat) > 2:
            left, right = flat[:-1], flat[1:]
            codes = np.where((left >= 0) & (right >= 0), left * width + right, -1)
            counts = np.bincount(codes[codes >= 0], minlength=width * width)
            counts[spent] = 0
            best = int(counts.argmax())
            if counts[best] < 2:
                break
            at = np.flatnonzero(codes == best)
            if best // width == best % width:  # of overlapping places every second one
                new_run = np.diff(at, prepend=-2) > 1
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if len(at) < 2:
                spent[best] = True
                continue
            rule = (best // width, best % width)
            flat[at] = len(self.runs)
            flat = np.delete(flat, at + 1)
            self.rules.append(rule)
            self.runs.append(self.runs[rule[0]] * self.runs[rule[1]])
        ends = np.flatnonzero(flat == -1)
        self.sequences = [part[part >= 0].tolist() for part in np.split(flat, ends[:-1] + 1)] if arrays else []

    def run(self, symbols: list[int]) -> Run:
        """The matrix and counts of a whole sequence of at least one symbol."""
        whole = self.runs[symbols[0]]
        for s in symbols[1:]:
            whole = whole * self.runs[s]
        return whole

    def solved(self, symbols: list[int]) -> tuple[int, str, tuple, int]:
        """(cost, edits, fault counts, illegal neighbours) of a sequence from start to end."""
        row, counts, illegal, last = FRESH, (0, 0, 0), 0, ""
        for s in symbols:
            run = self.runs[s]
            row = times(row, run.matrix)
            counts = tuple(a + b for a, b in zip(counts, run.counts))
            illegal += run.illegal + (bool(last) and last + run.first not in LEGAL)
            last = run.last
        cost, rope = finished(row)
        return cost, str(rope), counts, illegal
