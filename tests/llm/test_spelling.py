"""Spelling variants against a plain search over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from emberlog.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n string, form string"
LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, rule):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= rule.min_length and c >= rule.min_count}
    forms, out = {}, {}
    for w in n:
        around = [v for v in n if near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= rule.factor * n[w] else None
        out[w] = len(around)
    result = []
    for w, form in forms.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        result.append((w, form, root, n[w], out[w], None if form is None else n[form]))
    return sorted(result)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    letters = "aabcdeéÿß×zA"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 11))) for _ in range(90)]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 2, 5, 40])
        for _ in range(4):
            v, i = list(w), rng.randrange(len(w))
            kind = rng.randrange(3)
            v[i : i + (kind < 2)] = [] if kind == 0 else [rng.choice(letters)]
            words += ["".join(v)] * rng.choice([1, 2, 3, 12])
    words += ["abcabcabc"] * 3 + ["bcabcabca"] * 3 + ["cabcabcab"] * 30 + ["q" * 40] * 3 + ["q" * 41] * 40
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + [None, "", "1 2, 3", "x" * 5_000, "x" * 5_000]
    out = [(k if k % 5 else None, t, "w", "n", "f") for k, t in enumerate(texts)]
    return out + out[:3] * 2


@pytest.mark.parametrize("rule", [spelling.Rule(), spelling.Rule(4, 2, 2, cell=20), spelling.Rule(5, 1, 3, cell=7)])
def test_equals_search(spark, rows, rule):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = spelling.with_typos(spelling.runs(frame, spelling.Rule(min_length=1)))
    got = sorted(map(tuple, spelling.variants(spelling.vocabulary(found, rule), rule).collect()), key=lambda r: r[0])
    assert got == brute(rows, rule)


def test_upper_trees_part_and_lose_nothing(spark, monkeypatch):
    """With tiny cells, samples and batches every pair is still found, and no cell is much larger than asked for."""
    monkeypatch.setattr(spelling, "SAMPLE_ROWS", 150)
    monkeypatch.setattr(spelling, "QUERIES", 16)
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.choice([7, 8]))) for _ in range(900)})
    words += [w[:-1] + "z" for w in words[::3]] + [w[:3] + "y" + w[3:] for w in words[::4]]
    rule = spelling.Rule(min_count=1, cell=64)
    docs = spark.createDataFrame([(i, w, "", "", "") for i, w in enumerate(words)], SCHEMA)
    vocabulary = spelling.stage(spelling.vocabulary(spelling.runs(docs, rule), rule), "words")
    cells = spelling.fit_cells(vocabulary, rule)
    assert set(cells.trees) >= {7, 8} and all(t.planes for t in cells.trees.values())
    dealt = vocabulary.mapInArrow(spelling._dealt(cells), "cell bigint, kind int, size int, word binary, n bigint")
    own = dealt.where("kind = 0").groupBy("cell").count().collect()
    assert sum(r["count"] for r in own) == len(set(words)) and max(r["count"] for r in own) <= 3 * rule.cell
    got = {r.word: r.n_near for r in spelling.variants(vocabulary, rule).collect()}
    assert got == {w: sum(near(w, v) for v in set(words)) for w in set(words)}


def test_trees_meet_all_in_range():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (600, spelling.DIMENSIONS)).astype(np.int32)
    tree = spelling.Tree(points, 10)
    group_of = np.empty(600, dtype=int)
    for g, rows in enumerate(tree.groups):
        group_of[rows] = g
    assert max(map(len, tree.groups)) <= 10
    moved = points[:200].copy()
    up, down = rng.integers(0, spelling.DIMENSIONS, (2, 200))
    moved[np.arange(200), up] += 1
    moved[np.arange(200), down] -= 1
    met = set()
    for g, rows in tree.meet(moved, 1, 1):
        met |= {(int(r), g) for r in rows}
    assert all((i, group_of[i]) in met for i in range(200)) and len(met) < 200 * len(tree.groups) / 3


def test_empty_tables(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    for docs in (frame.limit(0), frame.where("text is null")):
        assert spelling.variants(spelling.vocabulary(spelling.with_typos(spelling.runs(docs)))).count() == 0
