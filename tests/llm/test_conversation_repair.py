"""Conversation repair against a plain search, one conversation at a time."""

import hashlib
import random
import re
from functools import lru_cache

import pytest
from emberlog.llm import conversation_repair as repair
from emberlog.llm import role_grammar
from emberlog.llm.role_grammar import Grammar, Rope
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, audit string, kind string"


def cheapest(roles, faults):
    """The best (cost, edits) by recursion from the right; '' none, b, d, t."""

    @lru_cache(None)
    def bounded(i, state, used):
        ways = [(0, "")] if i == len(roles) and state in "^a" else []
        if used < 3:
            cost, edits = bounded(i, {"^": "u", "s": "u", "u": "a", "a": "u"}[state], used + 1)
            ways.append((cost + 2, "I" + edits))
        if i < len(roles):
            cost, edits = bounded(i + 1, state, 0)
            ways.append((cost + 3, "D" + edits))
            if faults[i] not in ("b", "d"):
                extra = faults[i] == "t"
                if roles[i] and roles[i] in {"^": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    cost, edits = bounded(i + 1, roles[i], 0)
                    ways.append((cost + extra, "K" + edits))
                cost, edits = bounded(i + 1, "a" if state == "u" else "u", 0)
                ways.append((cost + 2 + extra, "R" + edits))
        return min(ways, default=(10**9, ""))

    return bounded(0, "^", 0)


def brute(rows):
    """The report of one conversation's rows (turn, role, text)."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashes[r[2]])
    hashes = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: r[2]))}
    rows, seen, faults = sorted(rows, key=key), set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest(tuple(initials), tuple(faults))
    out, last, queue = [], "", list(rows)
    for letter in audit:
        to = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((to, ""))
        else:
            _, role, text = queue.pop(0)
            if letter == "D":
                continue
            out.append((to if letter == "R" else role, text))
        last = out[-1][0][:1]
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha), out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(40), 40]:
        long = conv in (None, 40)
        for k in range(120 if long else rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "ultra"])
            text = rng.choice([f"One {k}.", f"two {k}", " \t\r\n", "", "same!", "same?", "héé 中?\u000b", f"long {k} " * 50])
            # Texts of one turn differ only in conversations whose order they cannot change.
            rows.append((conv, None if k == 0 and rng.random() < 0.3 else k + (k > 5), role, text, "x", "y", "z"))
    rows += [r for r in rows if rng.random() < 0.1] * 2
    return rows


def by_conversation(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((turn, role or " " if role is None else role, " " if text is None else text))
    return out


@pytest.mark.parametrize(("piece", "batch"), [(repair.PIECE, repair.BATCH), (5, 60)])
def test_report_and_rows_equal_search(spark, case, monkeypatch, piece, batch):
    monkeypatch.setattr(repair, "PIECE", piece)
    monkeypatch.setattr(repair, "BATCH", batch)
    frame = spark.createDataFrame(case, SCHEMA).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in repair.report(frame).collect()}
    want = {conv: brute(rows) for conv, rows in by_conversation(case).items()}
    assert got == {conv: report for conv, (report, _) in want.items()}
    lines = {}
    for r in repair.repaired(frame).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    assert lines == {conv: out for conv, (_, out) in want.items() if out}


def test_nulls_copies_and_empty_table(spark):
    rows = [(1, 0, None, None, 1), (1, 1, "user", "Hi.", 1), (2, 0, "user", "gone.", 0), (3, None, "user", "a.", 2), (3, None, "assistant", "b", 1)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, copies int")
    got = {r.conv_id: r for r in repair.report(frame).collect()}
    assert (got[1].blank, got[1].illegal, got[1].audit, got[1].cost) == (1, 1, "DKI", 5)
    assert (got[2].audit, got[2].cost, got[2].repaired_sha256) == ("", 0, hashlib.sha256().hexdigest())
    assert (got[3].gaps, got[3].duplicate, got[3].truncated) == (0, 1, 1)
    assert repair.report(frame.limit(0)).count() == repair.repaired(frame.limit(0)).count() == 0
    assert repair.damaged(spark.createDataFrame(case_of_nulls(), SCHEMA)).where("role is null or text is null").isEmpty()


def case_of_nulls():
    return [(None, None, None, None, None, None, None), (5, None, None, "x", None, None, None)]


def test_damage(spark):
    frame = spark.createDataFrame([(i, t, "assistant", "A. B! C?", "", "", "") for i in range(30) for t in range(4)], SCHEMA)
    import zlib

    for r in repair.damaged(frame).collect():
        code = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        assert (r.copies, r.text, r.role) == (
            {0: 0, 3: 2}.get(code, 1),
            {1: "", 2: "A B C"}.get(code, "A. B! C?"),
            "user" if code == 4 else "assistant",
        )


def test_grammar_spans_what_it_replaces():
    rng = random.Random(2)
    texts = [bytes(rng.choice([0, 4, 8, 8, 8, 9, 15]) for _ in range(rng.randint(1, 80))) for _ in range(60)] + [b"\x08" * 151]
    for limit in (0, 7, role_grammar.MAX_RULES):
        shared = Grammar(texts, limit)

        def terminals(symbol, shared=shared):
            if symbol < role_grammar.SYMBOLS:
                return [symbol]
            left, right = shared.rules[symbol - role_grammar.SYMBOLS]
            return terminals(left) + terminals(right)

        assert [[t for s in seq for t in terminals(s)] for seq in shared.sequences] == [list(t) for t in texts]
        assert len(shared.rules) <= limit
        for text, seq in zip(texts, shared.sequences):
            cost, audit, *_ = shared.solved(seq)
            roles = tuple("suao"[b // 4] for b in text)
            assert (cost, audit) == cheapest(roles, tuple(("", "b", "d", "t")[b % 4] for b in text))


def test_ropes_compare_like_strings():
    rng = random.Random(5)
    ropes = [Rope(rng.choice(["D", "I", "K", "R", "KK"])) for _ in range(20)]
    for _ in range(400):
        ropes.append(rng.choice(ropes[-60:]) + rng.choice(ropes[-60:]))
    for _ in range(400):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (str(a) < str(b)) and len(str(a)) == a.length


def test_one_conversation_spans_tasks(spark):
    """A conversation with most rows is cut into pieces of several tasks, and no task gets all its narrow rows."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k}.", "", "", "") for k in range(4_000)] + [(2, 0, "user", "x.", "", "", "")]
    keyed = repair._rows(spark.createDataFrame(rows, SCHEMA))
    ranged = repair.symbols(keyed).repartitionByRange(8, "conv_id", *repair.KEYS)
    shares = [r["n"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(shares) < 2_000
    assert [(r.cost, len(r.audit)) for r in repair.report(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id").collect()] == [(0, 4_000), (2, 2)]
