"""Benchmark windows in documents against a brute-force search."""

import random
import re

import pytest
from emberlog.llm import decontaminate
from pyspark.sql import functions as F

LOW = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, items, length=10):
    w, covered, named = words(text), set(), set()
    for name, item in items:
        v = words(item)
        for j in range(max(len(v) - length, 0) + 1 if v else 0):
            window = v[j : j + length]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    covered.update(range(i, i + len(window)))
                    named.add("" if name is None else str(name))
    return len(w), len(covered), sorted(named)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("a b c ñu É d2 e".split()) for _ in range(n))
    items = [(i, prose(rng.randint(1, 30))) for i in range(12)]
    items += [(2, "two words"), (50, items[3][1]), (51, ""), (52, None), (None, "It's null"), (10, "x y z"), (7, "A" * 9)]
    hard = items[0][1]
    texts = [prose(rng.randint(0, 120)) for _ in range(25)]
    texts += [f"{prose(5)}, {i[1]}. {prose(5)}" for i in items] + [hard.upper().replace(" ", "\n--\n"), "A B " * 50, None, "", " \t"]
    texts += ["two  WORDS", "two", "It s NULL", hard + " " + hard, "q " * 3_000 + "x y z", "AAAAAAAAA", "É é"]
    docs = [(k // 2 if k < 10 else k, t, "w", "s") for k, t in enumerate(texts)] + [(None, hard, "w", "s"), (None, "x y z", "w", "s")]
    return docs + docs[-2:] * 3 + docs[:1], items


@pytest.mark.parametrize("rule", [decontaminate.Windows(), decontaminate.Windows(broadcast_rows=0), decontaminate.Windows(4, 2)])
def test_equals_brute_force(spark, case, rule):
    docs, items = case
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, words string, spans string").repartition(3)
    report = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id bigint, text string"), rule)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_hit, r["items"]) for r in report.collect())
    assert got == sorted(((-1 if i is None else i), *brute(t, items, rule.length)) for i, t, *_ in docs)
    for r in report.where("n_hit > 0").collect():
        assert len({p for s in r.spans for p in range(s.place, s.end)}) == r.n_hit


def test_empty_tables(spark, case):
    docs = spark.createDataFrame(case[0], "doc_id bigint, text string, words string, spans string")
    items = spark.createDataFrame(case[1], "item_id bigint, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    free = decontaminate.contamination(docs, items.limit(0))
    assert free.count() == len(case[0]) and free.where("n_hit > 0 or size(items) > 0").isEmpty()


def test_places_stay_in_the_scan(spark, case):
    """With a small benchmark no words of documents are shuffled, and no Python runs."""
    docs = spark.createDataFrame(case[0][:20], "doc_id bigint, text string, a string, b string")
    items = decontaminate.item_windows(spark.createDataFrame(case[1], "item_id bigint, text string"), decontaminate.Windows())
    rows = decontaminate.with_row_key(docs).withColumn("words", decontaminate.words_of(F.col("text")))
    found = decontaminate.occurrences(rows, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
