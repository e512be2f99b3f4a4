"""Repair of conversation structure: cheapest edits to ``(s?(ua)+)?``, grammars shared by conversations.

A conversation is the rows of one id by turn (null turns first; rows of one turn by role, then by a
128-bit print of the text). Faults of a row, the first that fits: *blank* (no character other than white
space), *duplicate* (role and text occur earlier in the conversation), *truncated* (the last such
character is not ``.``, ``!`` or ``?``). Edits and their costs are those of ``role_grammar``.

1. Faults need no text: rows become narrow (keys, print, fault), equal rows are counted, and the earliest
   row of each (conversation, role, print) is found by a partial minimum, which marks the duplicates.
2. Narrow rows are range-sorted by conversation and turn, so one conversation may span many tasks. A task
   cuts its rows into pieces of at most ``PIECE`` symbols, builds one Re-Pair grammar for all different
   pieces of a batch, and multiplies matrices along each. Conversations that lie inside a task are done;
   a piece that may go on in another one returns its whole matrix.
3. The pieces of conversations that were cut are multiplied in their order.
4. Edits meet texts by a sort, not a join: rows of edits lie in front of the rows they edit, and a task
   reads both as a stream. It holds no conversation; only a digest, which is sequential, needs all texts
   of one conversation to pass one task.

Defined results: a null role or text is one space; a null turn counts as earliest and for no gap; null
ids are one conversation. ``copies`` (default 1) says how often a row counts; a conversation whose rows
all have 0 copies has an empty repair. Repeated rows are duplicates of each other. Other columns are not
read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from emberlog.llm import role_grammar as grammar
from emberlog.session import stage

PIECE = 4_096
# Symbols that share one grammar; a batch is held in memory.
BATCH = 1 << 19
KEYS = ["has_turn", "turn", "role", "print1", "print2"]
_KEY_TYPES = "has_turn boolean, turn bigint, role string, print1 bigint, print2 bigint"
_TOTALS = "cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
NAMES = {"u": "user", "a": "assistant"}
OUT_BYTES = 8 << 20


def damaged(conversations: DataFrame) -> DataFrame:
    """A fixed way to damage rows, by crc32(``conv_id:turn``) % 20; nulls become one space first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    code = F.crc32(
        F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")
    ) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(code == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def _text_fault(text: Column) -> Column:
    """Blank or truncated, by the last character that is no white space."""
    last = F.substring(F.rtrim(F.translate(text, "\t\n\u000b\u000c\r", "     ")), -1, 1)
    return (
        F.when(last == "", grammar.BLANK).when(last.isin(".", "!", "?"), grammar.NONE).otherwise(grammar.TRUNCATED)
    )


def _rows(rows: DataFrame) -> DataFrame:
    """conv_id, the keys of the order, copies and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    copies = F.col("copies").cast("bigint") if "copies" in rows.columns else F.lit(1).cast("bigint")
    return rows.select(
        "conv_id",
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.xxhash64(text).alias("print1"),
        F.xxhash64(F.lit(1), text).alias("print2"),
        copies.alias("copies"),
        text.alias("text"),
    )


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, keys, n, symbol, rest): different rows, how many there are, the first one's symbol and the others'."""
    fault = _text_fault(F.col("text"))
    narrow = (
        rows.where("copies > 0")
        .select("conv_id", *KEYS, "copies", fault.alias("fault"))
        .groupBy("conv_id", *KEYS)
        .agg(F.sum("copies").alias("n"), F.min("fault").alias("fault"))
    )
    same_text = ["conv_id", "role", "print1", "print2"]
    first = (
        narrow.groupBy(*same_text)
        .agg(F.min(F.struct("has_turn", "turn")).alias("first"))
        .select(*[F.col(c).alias(f"first_{c}") for c in same_text], "first")
    )
    met = F.col("conv_id").eqNullSafe(F.col("first_conv_id"))
    for c in same_text[1:]:
        met = met & (F.col(c) == F.col(f"first_{c}"))
    met = met & (F.col("has_turn") == F.col("first.has_turn")) & (F.col("turn") == F.col("first.turn"))
    initial = F.substring("role", 1, 1)
    role = F.lit(grammar.CLASSES.index("o"))
    for number, letter in enumerate(grammar.CLASSES[:-1]):
        role = F.when(initial == letter, number).otherwise(role)
    blank = F.col("fault") == grammar.BLANK
    later = F.when(blank, grammar.BLANK).otherwise(grammar.DUPLICATE)
    return narrow.join(first, met, "left").select(
        "conv_id",
        *KEYS,
        "n",
        (role * 4 + F.when(F.col("first").isNotNull(), F.col("fault")).otherwise(later)).alias("symbol"),
        (role * 4 + later).alias("rest"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, key of the first row, rows of that key before it, symbols, whole?) of sorted rows."""
    conv, key, skip, held, opened = None, None, 0, bytearray(), False
    cut = True  # the first conversation of a task may have begun in another one
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if opened and row[0] != conv:
                if held:
                    yield conv, key, skip, bytes(held), not cut
                held, cut = bytearray(), False
            conv, opened = row[0], True
            n, symbol, rest = row[6:]
            done = 0
            while done < n:
                if not held:
                    key, skip = row[1:6], done
                take = min(n - done, PIECE - len(held))
                held += bytes([rest]) * take
                if done == 0:
                    held[-take] = symbol
                done += take
                if len(held) == PIECE:
                    yield conv, key, skip, bytes(held), False
                    held, cut = bytearray(), True
    if held:
        yield conv, key, skip, bytes(held), False  # the last one may go on in the next task


_PIECE_SCHEMA = f"{_KEY_TYPES}, skip bigint, whole boolean, {_TOTALS}, audit string, outer string, costs array<bigint>, audits array<string>"


def _solve(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def solved(pieces: list[tuple]) -> pa.RecordBatch:
        different = sorted({(p[3], p[4]) for p in pieces})
        shared = grammar.Grammar([s for s, _ in different])
        answers = {}
        for (text, whole), sequence in zip(different, shared.sequences):
            if whole:
                cost, audit, counts, illegal = shared.solved(sequence)
                answers[text, whole] = (cost, *counts, illegal, audit, None, None, None)
            else:
                run = shared.run(sequence)
                ways = [way for row in run.matrix for way in row]
                costs = [None if w is None else w[0] for w in ways]
                audits = [None if w is None else str(w[1]) for w in ways]
                answers[text, whole] = (None, *run.counts, run.illegal, None, run.first + run.last, costs, audits)
        rows = [(p[0], *p[1], p[2], p[4], *answers[p[3], p[4]]) for p in pieces]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for piece in _cut(batches):
            pieces.append(piece)
            size += len(piece[3]) + 32
            if size >= BATCH:
                yield solved(pieces)
                pieces, size = [], 0
        if pieces:
            yield solved(pieces)

    return run


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one conversation multiplied in order: its edits, totals first."""
    pieces = pieces.sort_values([*KEYS, "skip"]).reset_index(drop=True)
    row, illegal, last, counts = grammar.FRESH, 0, "", [0, 0, 0]
    for p in pieces.itertuples():
        ways = [None if a is None else (int(c), grammar.Rope(a)) for c, a in zip(p.costs, p.audits)]
        row = grammar.times(row, [ways[i : i + 4] for i in range(0, 16, 4)])
        counts = [a + b for a, b in zip(counts, (p.blank, p.duplicate, p.truncated))]
        illegal += p.illegal + (bool(last) and last + p.outer[0] not in grammar.LEGAL)
        last = p.outer[1]
    cost, rope = grammar.finished(row)
    out = pieces.iloc[:1][["conv_id", *KEYS, "skip"]].copy()
    for name, value in zip(("cost", "blank", "duplicate", "truncated", "illegal"), (cost, *counts, illegal)):
        out[name] = int(value)
    out["audit"] = str(rope)
    return out


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, keys, skip, totals, audit): the cheapest edits of every conversation with rows, keyed by its first row."""
    kind = dict(rows.dtypes)["conv_id"]
    narrow = stage(symbols(rows), "conversation-symbols")
    ordered = narrow.repartitionByRange("conv_id", *KEYS).sortWithinPartitions("conv_id", *KEYS)
    empty = narrow.sparkSession.createDataFrame([], f"conv_id {kind}, {_PIECE_SCHEMA}")
    pieces = stage(ordered.mapInArrow(_solve(to_arrow_schema(empty.schema)), empty.schema), "conversation-pieces")
    columns = ["conv_id", *KEYS, "skip", "cost", "blank", "duplicate", "truncated", "illegal", "audit"]
    joined = (
        pieces.where("not whole")
        .groupBy("conv_id")
        .applyInPandas(_joined, f"conv_id {kind}, {_KEY_TYPES}, skip bigint, {_TOTALS}, audit string")
    )
    return pieces.where("whole").select(columns).unionByName(joined)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Edited rows and ends of conversations of a sorted stream of edits and texts.

    ``("row", conv_id, turn, edit, role, text)`` for every row that the repair keeps, changes, deletes or
    inserts, and ``("end", conv_id, gaps, totals, audit)`` after the rows of a conversation.
    """
    conv, opened = None, False
    audit, at, totals, least, turn, turns = "", 0, (0,) * 5, None, None, 0

    def inserted(last: str) -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            role = "assistant" if last == "user" else "user"
            yield "row", conv, None, "I", role, ""
            last, at = role, at + 1

    def end() -> Iterator[tuple]:
        yield from inserted(written)
        gaps = 0 if least is None else turn - least + 1 - turns
        yield "end", conv, gaps, totals, audit

    written = ""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if opened and row[0] != conv:
                yield from end()
                audit, at, totals, least, turn, turns, written = "", 0, (0,) * 5, None, None, 0, ""
            conv, opened = row[0], True
            has_turn, number, role, copies, text = row[1], row[2], row[3], row[4], row[5]
            if text is None:  # edits, or a row that was dropped
                if row[6] is not None:
                    audit, totals = row[6], row[7:12]
                continue
            if has_turn and (least is None or number != turn):
                least, turn, turns = number if least is None else least, number, turns + 1
            for _ in range(copies):
                for event in inserted(written):
                    written = event[4]
                    yield event
                edit, to = audit[at], role
                at += 1
                if edit == "R":
                    to = "assistant" if written == "user" else "user"
                if edit != "D":
                    written = NAMES.get(to[:1], to)
                yield "row", conv, number if has_turn else None, edit, to, text
    if opened:
        yield from end()


def _report(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digest, any_ = [], hashlib.sha256(), False
        for event in _replay(batches):
            if event[0] == "row":
                if event[3] != "D":
                    digest.update(f"{chr(10) if any_ else ''}{event[4]}:{event[5]}".encode())
                    any_ = True
                continue
            _, conv, gaps, (cost, *counts), audit = event
            rows.append((conv, gaps, *counts, cost, audit, digest.hexdigest()))
            digest, any_ = hashlib.sha256(), False
            if len(rows) == 4_096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return run


def _repaired(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, place = [], 0, 0
        for event in _replay(batches):
            if event[0] == "end":
                place = 0
            elif event[3] != "D":
                rows.append((event[1], place, event[2], event[4], event[5], event[3]))
                place += 1
                size += len(event[5]) + 64
                if size >= OUT_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def _streamed(rows: DataFrame) -> DataFrame:
    """Texts and their edits of each conversation in order, edits first."""
    keyed = _rows(rows)
    totals = ["cost", "blank", "duplicate", "truncated", "illegal"]
    none = [F.lit(None).cast("string").alias("audit"), *[F.lit(None).cast("bigint").alias(c) for c in totals]]
    texts = keyed.select("conv_id", *KEYS, F.lit(1).alias("kind"), "copies", F.when(F.col("copies") > 0, F.col("text")).alias("text"), *none)
    first = edits(keyed).select(
        "conv_id", *KEYS, F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("copies"), F.lit(None).cast("string").alias("text"), "audit", *totals
    )
    return (
        texts.unionByName(first)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", *KEYS)
        .select("conv_id", "has_turn", "turn", "role", "copies", "text", "audit", *totals)
    )


def _mapped(rows: DataFrame, function: Callable, columns: str) -> DataFrame:
    schema = rows.sparkSession.createDataFrame([], f"conv_id {dict(rows.dtypes)['conv_id']}, {columns}").schema
    return _streamed(rows).mapInArrow(function(to_arrow_schema(schema)), schema)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the rows of every repaired conversation, inserted ones with a null turn."""
    return _mapped(rows, _repaired, "place bigint, turn bigint, role string, text string, edit string")


def report(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, fault counts, illegal neighbours, cost, edits, and a digest of the repaired rows."""
    return _mapped(
        rows,
        _report,
        "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    )
