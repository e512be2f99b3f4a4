"""The corpus operators against brute force, on rows with nulls, copies, ties, long and empty texts."""

import collections
import hashlib
import re
import random
import zlib

import numpy as np
import pytest
import zstandard

from emberlog.llm import (
    anchors,
    automaton_dedup,
    mixing,
    ngram_join,
    packing,
    quality,
    suffix_dedup,
    token_files,
    tokens,
    url_filter,
    winnowing,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(row):
    return row[1] or ""


def by_null(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def covered(sequences, length):
    """For each sequence, whether a unit lies in a window that occurs at least twice."""
    count = collections.Counter(s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        mask = np.zeros(len(s), dtype=bool)
        for i in range(len(s) - length + 1):
            if count[s[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


# Row keys


def test_texts_under_one_null_id_stay_apart(spark):
    """The two texts without an id have the same 32-bit Murmur hash."""
    numbers = lambda low: " ".join(map(str, range(low, low + 100)))
    first, second, third = f"63939 {numbers(1000)}", f"183158 {numbers(5000)}", f"x {numbers(1000)}"
    rows = spark.createDataFrame([(None, first), (None, second), (1, third)], "doc_id long, text string")
    assert rows.where("doc_id is null").selectExpr("hash(text) as h").distinct().count() == 1
    unnamed = rows.where("doc_id is null")
    assert {r.text for r in ngram_join.one_of_each(unnamed).collect()} == {first, second}
    left = [r.text for r in suffix_dedup.deduplicated(rows).collect()]
    assert second in left and first not in left
    report = automaton_dedup.report(rows).where("doc_id is null").collect()
    assert sorted(r.n_removed for r in report) == [0, 100]


# Winnowing


def test_winnowing_report(documents, corpus):
    rows = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = collections.defaultdict(list)
    for r in winnowing.edit_report(documents.drop("size")).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    unique = collections.Counter(r[0] for r in rows)
    for row, follow in zip(rows, rows[1:] + rows[:1], strict=True):
        if unique[row[0]] > 1 or unique[follow[0]] > 1:
            continue
        text, after = text_of(row), text_of(follow)
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        (r,) = got[row[0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == after:
            assert r.near_next == 1
        if edited == text:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1


def test_winnowing_guarantee_and_ties(spark):
    shared = "a shared passage of a few code points!"[: winnowing.K + winnowing.W - 1]
    texts = ["xyz 123 " * 3 + shared + " tail one", "other words " + shared, "ab" * 60, "short", "", None]
    rows = winnowing.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).collect()
    prints = [{p["hash"] for p in r.fingerprint} for r in rows]
    assert prints[0] & prints[1]
    # A text of period two has two different runs; the rightmost least one of every window is kept.
    kept = [p["position"] for p in rows[2].fingerprint]
    assert kept == sorted(kept) and len({p % 2 for p in kept}) == 1 and len(prints[2]) == 1
    # The last position of each window with the kept parity.
    runs = 120 - winnowing.K + 1
    assert kept == sorted({max(p for p in range(i, i + winnowing.W) if p % 2 == kept[0] % 2) for i in range(runs - winnowing.W + 1)})
    assert len(rows[3].fingerprint) == 1 and rows[4].fingerprint == [] and rows[5].fingerprint == []


def test_winnowing_blocks_agree(spark, monkeypatch):
    text = " ".join(str(i * i) for i in range(300))
    df = spark.createDataFrame([(text,)], "text string")
    whole = winnowing.fingerprints(df).first().fingerprint
    monkeypatch.setattr(winnowing, "BLOCK", 100)
    assert winnowing.fingerprints(df).first().fingerprint == whole


def test_winnowing_of_edited_texts_equals_whole(documents, spark):
    """The edited text's fingerprint, put together from parts, is the one that the text has by itself."""
    slim = documents.select("doc_id", "text").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in slim.collect()}
    order = sorted(texts, key=lambda d: (d is None, -(d or 0)))
    edited = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        third = len(texts[a]) // 3
        edited.append((a, texts[a], texts[a][: len(texts[a]) - third] + texts[b][:third]))
    df = spark.createDataFrame(edited, "doc_id bigint, own string, edited string")
    whole = {
        r.doc_id: (r.own, r.edited)
        for r in df.select(
            "doc_id",
            *[winnowing.as_string(winnowing.chosen(winnowing.F.col(c))).alias(c) for c in ("own", "edited")],
        ).collect()
    }
    for r in winnowing.edit_report(slim).collect():
        assert (r.fingerprint, r.edited_fingerprint) == whole[r.doc_id]


# URLs


def brute_rule(host, path, rules):
    fits = [
        r for r in rules
        if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith("/" + p))(*r.target.split("/", 1))
    ]
    return max(fits, key=lambda r: len(r.target), default=None)


def test_url_rules_and_reputation(spark):
    rules = (
        url_filter.Rule("block", "net/"), url_filter.Rule("allow", "example.net/en/"),
        url_filter.Rule("block", "example.com/de/"), url_filter.Rule("allow", "org/fr/"),
    )
    urls = [
        "http://a.Example.NET/en/1", "https://example.net/de/2?x=://y", "HTTP://EXAMPLE.com/de/", "x://example.com/de",
        "http://notexample.com/de/1", "http://b.org/fr/x#f", "no scheme", None, "://", "http://net", "http://net/",
        "http://É.net/", "ftp://h:80?q/de/", "http://example.com#/de/",
    ]
    rows = [(i, u, None) for i, u in enumerate(urls)] * 2
    rows += [(100 + i, "http://bad.host.test/p", True) for i in range(80)]
    rows += [(200 + i, f"http://good{i % 7}.site.test/p", False) for i in range(80)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, bad boolean"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        url = dict((a, b) for a, b, _ in rows)[r.page_id]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        lower = str.maketrans(url_filter.UPPER, url_filter.LOWER)
        host, path = (m[1].translate(lower), m[2]) if m else ("", "")
        assert (r.host, r.path) == (host, path)
        rule = brute_rule(host, path, rules)
        assert r.rule == (rule.target if rule else None)
        assert r.verdict == (rule.verdict if rule else ("block" if host == "bad.host.test" else "allow"))


def test_url_shrinkage(spark):
    rows = [("a.x.test", i < 5) for i in range(6)] + [(f"h{i}.y.test", i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "host string, bad boolean")
    got = {r.host: r for r in url_filter.reputations(df).collect()}
    assert 1 / 3 < got["a.x.test"].bad_mean < 5 / 6
    assert all(0 <= r.bad_low <= r.bad_mean <= 1 for r in got.values())
    assert url_filter.reputations(df.where("false")).collect() == []


# Packing


def check_packing(pieces, counts, ids=None):
    at = collections.Counter()
    for r in sorted(pieces, key=lambda r: (r.doc_id is not None, r.doc_id, r.start)):
        at[r.doc_id] += r.length
    assert at == counts
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append(r)
    padding = 0
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1]]
        size = sum(r.length for r in rows)
        assert size <= packing.CAPACITY
        padding += 0 if size & (size - 1) == 0 else packing.CAPACITY - size
    return padding


def test_packing(documents, corpus):
    path = tokens.public_tokenizer("word_bpe_49k.json")
    pieces = packing.pack(documents, path).collect()
    encoder = tokens.encoder(path)
    ids = [[*encoder.tokenizer.encode(text_of(r), add_special_tokens=False).ids, 1] for r in corpus]
    counts = collections.Counter()
    for r, x in zip(corpus, ids, strict=True):
        counts[r[0]] += len(x)
    padding = check_packing(pieces, counts)
    assert padding <= 0.02 * sum(counts.values())
    known = {r[0]: x for r, x in zip(corpus, ids, strict=True)}
    repeated = {k for k, n in collections.Counter(r[0] for r in corpus).items() if n > 1}
    for p in pieces:
        if p.doc_id not in repeated:
            part = np.array(known[p.doc_id][p.start : p.start + p.length], dtype="<u4")
            assert (p.ids_crc32, p.doc_tokens) == (zlib.crc32(part.tobytes()), len(known[p.doc_id]))


@pytest.mark.parametrize(
    "histogram",
    [{1500: 1000}, {1: 5}, {2047: 3, 1: 3}, {1025: 40, 1023: 41}, {i: i % 13 for i in range(1, 2048)}, {}, {0: 7}],
)
def test_packing_plan(histogram):
    counts = np.zeros(packing.CAPACITY, dtype=np.int64)
    for k, v in histogram.items():
        counts[k] = v
    where = packing.plan(counts)
    used = collections.defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            pieces = packing.pieces_of(length + packing.CAPACITY, rank, where)
            assert sum(p[1] for p in pieces) == length + packing.CAPACITY
            for start, size, sequence, order in pieces:
                used[sequence].append(size)
    total = sum(map(sum, used.values()))
    sizes = [sum(x) for x in used.values()]
    assert all(x <= packing.CAPACITY for x in sizes)
    assert sum(0 if x & (x - 1) == 0 else packing.CAPACITY - x for x in sizes) <= 0.02 * total


def test_cutting_stock_reaches_the_bound():
    widths, demand = np.array([3, 5, 7, 8]), np.array([40.0, 30.0, 20.0, 10.0])
    patterns, amounts = packing.cutting_stock(widths, demand, 20, gap=0.0)
    assert np.allclose(patterns @ amounts, demand) and (patterns.T @ widths <= 20).all()
    assert amounts.sum() == pytest.approx(widths @ demand / 20)


# Substrings


def test_suffix_search_finds_all():
    rng = np.random.default_rng(3)
    for length in (1, 2, 5, 9):
        for _ in range(20):
            texts = [bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) for _ in range(6)]
            texts.append(texts[0])
            mine = suffix_dedup.repeated_starts(texts, length)
            count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
            for t, found in zip(texts, mine, strict=True):
                assert found.tolist() == [i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]


def test_suffixes_that_differ_early_are_not_sorted_again(monkeypatch):
    """Unlike before, a round sorts what agrees so far only, and texts may be shorter than the reach."""
    assert [x.tolist() for x in suffix_dedup.repeated_starts([b"abc", b"abc"], 200)] == [[], []]
    sizes, sort = [], np.argsort
    monkeypatch.setattr(suffix_dedup.np, "argsort", lambda x, **k: sizes.append(len(x)) or sort(x, **k))
    text = bytes(np.random.default_rng(5).integers(0, 256, 3_000).astype(np.uint8))
    symbols = np.append(np.frombuffer(text + text[:300], dtype=np.uint8).astype(np.int64), 256)
    suffix_dedup.suffix_order(symbols, 200)
    assert sizes[0] == 3_301 and max(sizes[1:]) <= 600


def test_automaton_finds_all():
    rng = np.random.default_rng(4)
    for length in (1, 2, 4):
        for _ in range(20):
            texts = [" ".join(rng.choice(list("abc"), rng.integers(1, 30))).encode() for _ in range(5)]
            texts.append(texts[1])
            words = [tuple(t.split(b" ")) for t in texts]
            count = collections.Counter(w[i : i + length] for w in words for i in range(len(w) - length + 1))
            for w, found in zip(words, automaton_dedup.repeated_starts(texts, length), strict=True):
                assert found.tolist() == [i for i in range(len(w) - length + 1) if count[w[i : i + length]] > 1]


@pytest.mark.parametrize("crowd", [anchors.CROWD, 1])
def test_suffix_dedup(documents, corpus, monkeypatch, crowd):
    monkeypatch.setattr(anchors.repeated_spans, "__defaults__", (crowd,))
    data = [text_of(r).encode() for r in corpus]
    want = []
    for row, x, mask in zip(corpus, data, covered(data, 200), strict=True):
        kept = bytes(np.frombuffer(x, np.uint8)[~mask])
        runs = int(np.sum(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
        want.append((row[0], len(x), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.report(documents).collect()]
    assert by_null(got) == by_null(want)


def test_suffix_dedup_keeps_rows_and_columns(documents, corpus):
    got = suffix_dedup.deduplicated(documents)
    assert got.columns == documents.columns
    rows = got.collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.text is None or r.n_chars in (len(r.text), None)
    before = {r[0]: r[1] for r in corpus}
    assert sum(r.text == before[r.doc_id] for r in rows) > 20


@pytest.mark.parametrize("crowd", [anchors.CROWD, 1])
def test_automaton_dedup(documents, corpus, monkeypatch, crowd):
    monkeypatch.setattr(anchors.repeated_spans, "__defaults__", (crowd,))
    words = [tuple(WORD.findall(text_of(r))) for r in corpus]
    want = []
    for row, w, mask in zip(corpus, words, covered(words, 35), strict=True):
        kept = " ".join(x for x, m in zip(w, mask, strict=True) if not m)
        want.append((row[0], len(w), int(mask.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in automaton_dedup.report(documents).collect()]
    assert by_null(got) == by_null(want)


def test_segments_hold_every_window_once(monkeypatch):
    units = np.random.default_rng(1).integers(0, 3, 1_000)
    for block in (anchors.BLOCK, 64):
        monkeypatch.setattr(anchors, "BLOCK", block)
        anchor, first, windows, prints = anchors.segments(units, 20, 8)
        assert np.concatenate([np.arange(a, a + n) for a, n in zip(first, windows, strict=True)]).tolist() == list(range(981))


# Mixing


def test_mixing(documents, corpus):
    rows = mixing.mixed_sizes(documents).collect()
    again = mixing.mixed_sizes(documents.repartition(5)).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id, r.size, r.target, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == len(corpus)
    sizes = collections.Counter()
    for r in corpus:
        sizes[r[3]] += len(WORD.findall(text_of(r)))
    total, weights = sum(sizes.values()), {"a": 1, "b": 2, None: 3}
    target = {s: 0.0 for s in sizes}
    open_, left = set(sizes), float(total)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        if not full:
            target |= {s: weights[s] * level for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    taken = collections.Counter()
    for r in rows:
        source = next(s for s in sizes if sizes[s] == r.source_size)
        assert r.target == pytest.approx(target[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 + 1e-6 for s in sizes)


def test_mixing_reshares_and_orders(spark):
    rows = [(i, "w " * 10, "small") for i in range(2)] + [(10 + i, "w " * 10, "big") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = mixing.mix(df, weights=(1, 50)).collect()  # the small source wants 98 % and may give 60 words
    assert {r.source: r.target for r in got} == {"small": pytest.approx(60), "big": pytest.approx(2020 - 60)}
    order = sorted((r for r in got if r.taken), key=lambda r: r.position)
    assert [r.finish for r in order] == sorted(r.finish for r in order)
    assert [r.position for r in order] == [0, *np.cumsum([r.taken for r in order])[:-1]]


def test_mixed_documents(documents, corpus):
    got = mixing.mixed_documents(documents)
    assert got.columns == documents.columns
    words = sum(len(WORD.findall(r.text)) for r in got.collect())
    assert words == sum(r.taken for r in mixing.mixed_sizes(documents).collect())


# Quality


def brute_repeats(words):
    mask, count = [False] * len(words), collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    for i in range(len(words) - 7):
        if count[tuple(words[i : i + 8])] > 1:
            mask[i : i + 8] = [True] * 8
    return sum(mask)


def test_quality(documents, corpus):
    got = {}
    for r in quality.quality(documents.withColumnRenamed("size", "kept")).collect():
        got.setdefault(r.doc_id, r)
    for row in corpus:
        if row[0] is None:
            continue
        text, r = text_of(row), got[row[0]]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeats = brute_repeats(words)
        failed = len(words) < 20 or 100 * repeats > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, failed,
        )
        assert not (r.kept and failed)
        if text:
            assert r.ratio == len(text.encode()) / len(zstandard.ZstdCompressor(level=3).compress(text.encode()))


def test_quality_bands_reject_junk(spark):
    rng = np.random.default_rng(0)
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 60)) for _ in range(100))
    dull = " ".join(f"a{'b' * 200}{i}" for i in range(60))
    half = noise + " " + " ".join(["the", "of", "and"][i % 3] + str(i % 2) for i in range(7))
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' and n_chars > 1500")
    df = spark.createDataFrame([(noise,), (dull,), (half,)], "text string")
    assert quality.accepted(df).count() == 0
    assert quality.accepted(prose).count() > 0.8 * prose.count()
    assert quality.accepted(df).columns == ["text"]


def test_quality_bands_on_labels_outside_the_fit(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.labelled(docs, labels).cache()
    assert quality.fitted(rows.where("clean and fold = 0")) == quality.Bands()
    judged = quality.quality(rows.where("fold = 1")).where("not base_failed")
    kept = {(r.clean, r.kept): r["count"] for r in judged.groupBy("clean", "kept").count().collect()}
    clean, junk = ({k: kept.get((c, k), 0) for k in (True, False)} for c in (True, False))
    assert clean[False] <= 0.01 * sum(clean.values())
    assert junk[False] >= 0.6 * sum(junk.values())
    rows.unpersist()


def test_quality_chunks_have_their_own_bands():
    bands = quality.Bands()
    assert bands.holds(5_000, 2.3) and not bands.holds(5_000, 2.4) and not bands.chunk_holds(4_096, 2.3)


# N-gram join


def brute_components(corpus, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in corpus:
        w = WORD.findall(text_of(r).translate(lower))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(corpus)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(corpus):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(corpus, sets, strict=True))]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(documents, corpus, n, percent):
    got = [tuple(r) for r in ngram_join.components_of(documents, ngram_join.Join(n, percent)).collect()]
    assert by_null(got) == by_null(brute_components(corpus, n, percent))


def test_ngram_join_of_chains(spark):
    """Neighbours link, ends do not; blocks are small, so stars leave work for whole groups."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[7 * i : 7 * i + 120]), None, "s") for i in range(40)]
    rows += [(1_000 + i, " ".join(words[9 * i : 9 * i + 110] + ["z"]), None, "s") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    got = [tuple(r) for r in ngram_join.components_of(df).collect()]
    assert by_null(got) == by_null(brute_components(rows, 4, 85))


def test_signatures_meet_whenever_sets_link():
    rng, join = np.random.default_rng(5), ngram_join.Join()
    for size in (3, 7, 12, 13, 30, 95, 400):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop, add = rng.integers(0, size // 6 + 1), rng.integers(0, size // 6 + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if len(b) and join.links(len(a), len(b), shared) and shared < max(len(a), len(b)):
                assert np.intersect1d(ngram_join.signatures(a, join), ngram_join.signatures(b, join)).size


def test_one_of_each(documents, corpus):
    got = ngram_join.one_of_each(documents, ngram_join.Join())
    assert got.columns == documents.columns
    kept = collections.Counter(r.doc_id for r in got.collect())
    want = brute_components(corpus, 4, 85)
    assert {c for _, n, c in want if n} <= set(kept)
    assert all(c == d for d, n, c in want if n and d in kept and d is not None)
    assert max(kept[k] for k in kept if k is not None) == 1


# Token files


def test_token_files(spark, documents, corpus):
    path = tokens.public_tokenizer("byte_bpe_50k.json")
    manifest = token_files.write_files(documents, path, 0, token_files.shared_uri(spark, "tokens"), file_rows=30)
    got = [tuple(r) for r in token_files.read_files(manifest).collect()]
    encoder = tokens.encoder(path).tokenizer
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0], text_of(r).encode()))
    want, start = [], 0
    for r in rows:
        ids = [*encoder.encode(text_of(r), add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert by_null(got) == by_null(want)
    wanted = rows[20][0]
    assert token_files.read_documents(manifest, [wanted])[wanted] == [*encoder.encode(text_of(rows[20]), add_special_tokens=False).ids, 0]


def test_token_file_is_plain_zstandard_and_checked(tmp_path):
    rng, name = np.random.default_rng(2), tmp_path / "x.zst"
    ids = [rng.integers(0, 50_000, n).astype("<u2") for n in (5, 0, 3_000, 40_000, 1)]
    with open(name, "wb") as sink:
        writer = token_files.Writer(sink, frame_bytes=4_096)
        for i, x in enumerate(ids):
            writer.add(i, x.tobytes(), len(x))
        writer.close()
    raw = name.read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain == b"".join(x.tobytes() for x in ids)
    with open(name, "rb") as source:
        reader = token_files.Reader(source)
        for i in (3, 0, 4, 1, 2):
            assert reader.document(i).tolist() == ids[i].tolist()
    damaged = bytearray(raw)
    damaged[8] ^= 1
    name.write_bytes(bytes(damaged))
    with open(name, "rb") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(source).document(0)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_equals_whole(name):
    encoder = tokens.Encoder(tokens.public_tokenizer(name))
    texts = [
        "", " ", "\n\n a  b\t\tc \r\n", "don't I'll  we've 's", "a\u00a0b \u2003 c", "É\u0301 ß ΣΑΣ Σ. İ", "x" * 3_000,
        "<|endoftext|> <|startoftext|>a", "中文 和\u3000字 😀😀 \x1c y", " lead", "trail ", "a\x0b\x0cb", "1234 5.6,7 -- !!!\n",
        "a\u200bb \ufeffc", "e\u0301 \u0301x",
    ]
    rng = random.Random(1)
    signs = "abÀéßÿ×,.;:!? \n\t'\"-)(0123_<>|#中😀"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(2_000)]
    for text in [*texts, " ".join(texts), "\n".join(reversed(texts))]:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), dtype=encoder.dtype).tolist() == want, text


# Empty tables


def test_empty_tables(spark, nothing):
    path = tokens.public_tokenizer("byte_bpe_50k.json")
    folder = token_files.shared_uri(spark, "no-tokens")
    frames = [
        winnowing.edit_report(nothing), winnowing.fingerprints(nothing), packing.pack(nothing, path),
        suffix_dedup.report(nothing), suffix_dedup.deduplicated(nothing), automaton_dedup.report(nothing),
        mixing.mixed_sizes(nothing), mixing.mixed_documents(nothing), quality.quality(nothing), quality.accepted(nothing),
        ngram_join.components_of(nothing), ngram_join.one_of_each(nothing),
        token_files.read_files(token_files.write_files(nothing, path, 0, folder)),
    ]
    assert [df.count() for df in frames] == [0] * len(frames)
