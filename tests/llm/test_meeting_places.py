"""Step 3 of the n-gram join: what is sent grows with the rows, and leaving crowded places out loses no link."""

import random

import numpy as np

from emberlog.llm import ngram_join
from emberlog.llm.ngram_join import Join, signatures, spare_places, tiles_of


def family_texts(families, rng):
    """Five texts of every family: passages shared with the next families, and own words; none links with another."""
    passages = [[str(rng.random()) for _ in range(10)] for _ in range(families + 5)]
    return [
        " ".join(sum(passages[i : i + 6], []) + [str(rng.random()) for _ in range(8)])
        for i in range(families)
        for _ in range(5)
    ]


def test_rows_of_open_places_follow_the_texts(spark, monkeypatch):
    """Families that meet in a chain are one group; four times as many must not send sixteen times the rows."""
    monkeypatch.setattr(ngram_join, "TILE_ELEMENTS", 400)
    sent, compare = [], ngram_join._compare

    def counted(places, *others):
        sent.append(places.count())
        return compare(places, *others)

    monkeypatch.setattr(ngram_join, "_compare", counted)
    for families in (6, 24):
        texts = family_texts(families, random.Random(11))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        assert all(r.doc_id == r.component_id for r in ngram_join.components_of(docs).collect())
    assert len(sent) == 4  # stars and open places, twice
    assert sent[1] > 0 and sent[3] < 6 * sent[1]


def test_linked_sets_meet_without_their_most_crowded_places():
    """Copies of a few sets with changed elements: every pair that links keeps a place in common."""
    rng = np.random.default_rng(9)
    for join in (Join(), Join(5, 80)):
        sets = []
        for size in (4, 9, 14, 30, 61, 150, 400):
            base = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            for _ in range(12):
                change = int(rng.integers(0, size // 5 + 2))
                kept = rng.permutation(base)[change:]
                sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**64, change, dtype=np.uint64)])))
        places = [signatures(x, join) for x in sets]
        names, crowds = np.unique(np.concatenate(places), return_counts=True)
        crowd = dict(zip(names.tolist(), crowds.tolist(), strict=True))
        left, dropped = [], 0
        for found, own in zip(sets, places, strict=True):
            mine = set()
            for tile in set(tiles_of(len(found), join)):
                order = sorted((p for p in own.tolist() if p & 1 == tile & 1), key=lambda p: (-crowd[p], -p))
                spare = spare_places(found, join, tile)
                mine |= set(order[spare:])
                dropped += spare
            left.append(mine)
        linked = 0
        for i in range(len(sets)):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if join.links(len(sets[i]), len(sets[j]), shared) and shared < max(len(sets[i]), len(sets[j])):
                    linked += 1
                    assert left[i] & left[j]
        assert linked > 30 and dropped > 50


def test_each_class_is_in_a_place_once(spark):
    """Copies dealt to several partitions do not make a place more crowded."""
    texts = family_texts(2, random.Random(3))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 4)], "row_id long, text string")
    keyed = docs.selectExpr("row_id", "hash(text) + 0L as row_hash", "text").repartition(5)
    rows = ngram_join.meeting_places(keyed, Join(), len(texts) * 4).collect()
    at = {}
    for r in rows:
        at.setdefault(r["place"], []).append(r)
    assert at
    for found in at.values():
        classes = [r["class"] for r in found]
        assert len(set(classes)) == len(classes) > 1
        assert all(r["crowd"] == len(classes) and r["centre"] == min(classes) for r in found)
