"""The first step of the n-gram join loses no pair that links."""

import random

import numpy as np

from emberlog.llm import ngram_join
from emberlog.llm.ngram_join import Join, folded, possible, short_marks, tiles_of


def near_sets(rng, size, join):
    """Two sets of hashes that just link."""
    pool = np.unique(rng.integers(0, 2**64, size * 2, dtype=np.uint64))[: size * 2]
    rng.shuffle(pool)
    base = pool[:size]
    for drop in range(size, -1, -1):
        other = np.concatenate([base[drop:], pool[size : size + drop]])
        if len(other) and join.links(size, len(other), size - drop):
            return np.sort(base), np.sort(other)


def test_short_marks_meet_whenever_sets_link():
    rng = np.random.default_rng(3)
    for join in (Join(), Join(5, 80)):
        for size in [*range(1, 60), 200, 1_000]:
            for _ in range(5):
                one, other = near_sets(rng, size, join)
                other = other[: max(1, len(other) - int(rng.integers(0, 3)))]
                shared = len(np.intersect1d(one, other))
                if not join.links(len(one), len(other), shared) or np.array_equal(one, other):
                    continue
                for tile in set(tiles_of(len(one), join)) & set(tiles_of(len(other), join)):
                    a, b = short_marks(one, join, tile), short_marks(other, join, tile)
                    assert len(a) == len(b) and ((a == b) & (a != 0)).any()


def test_folded_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(4)
    join = Join()
    for size in (5, 250, 260, 500, 3_000):
        one, other = near_sets(rng, size, join)
        maps = []
        for found, width in ((one, 4_096), (other, 512)):
            bits = np.zeros(width, dtype=bool)
            bits[(found & np.uint64(width - 1)).astype(np.int64)] = True
            maps.append(np.packbits(bits).tobytes())
        sizes = np.array([len(one), len(other)])
        assert list(possible(0, np.array([1]), sizes, folded(maps), join)) == [1]


def test_groups_in_blocks_give_the_same_components(spark, monkeypatch):
    """Chains of neighbours below and above the threshold, in tiles of a few sets, against all pairs."""
    monkeypatch.setattr(ngram_join, "TILE_ELEMENTS", 400)
    rng = random.Random(5)
    texts = []
    for _ in range(4):
        words = [str(rng.random()) for _ in range(60)]
        for _ in range(25):
            words = list(words)
            for _ in range(rng.randint(1, 2)):
                words[rng.randrange(len(words))] = str(rng.random())
            texts.append(" ".join(words))
    join = Join()
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if join.links(len(sets[i]), len(sets[j]), len(sets[i] & sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.components_of(docs, join).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert len(set(got.values())) > 4
