"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A benchmark item is cut into *windows* of ``length`` consecutive words (a shorter item is one window). A
document contains a window when the same words stand next to each other in it; its words inside such
places are *hit*. As the whole window must be there, all its shingles (runs of ``shingle`` words) must be,
so the necessary prefix of a window in any order of shingles has one element. Shingles are ordered by
rarity, counted over all documents, so each window is looked up by its rarest shingle alone:

1. texts become arrays of words once (written);
2. shingles of items are counted in all documents, partial counts first;
3. the rarest shingle of each window, and its offset there, meets the shingles of documents; the place
   must leave room for the whole window before and behind (positional and length bound);
4. the words of the window-sized place are compared with those of the window.

The table of prefixes is broadcast when it has at most ``BROADCAST_ROWS`` rows of bounded width: then 3
and 4 run inside the scan and only true places leave it. A larger benchmark is joined by shuffling narrow
rows (shingle, document, place), and places meet their document's words by its key. Equal windows of
several items are looked up once.

Defined results: a null text has no words; an item without words has no window and occurs nowhere; an
item id is compared as a string and a null one is the empty string; rows with the same item id are one
item with the windows of all of them; documents with the same id and text are repeated rows and get a
result each, null ids included. Empty tables give no rows (no documents) or no hits (no items). Other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import text_or_empty, with_row_key
from emberlog.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Runs of characters that separate words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Prefix rows (some 20 words each) that may be broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Windows:
    """Words of a window and of a shingle."""

    length: int = 10
    shingle: int = 3
    broadcast_rows: int = BROADCAST_ROWS


def words_of(text: Column) -> Column:
    """Words of a text; separators at its ends leave empty strings, which are no words."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def item_windows(items: DataFrame, rule: Windows, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window): every distinct window of every item."""
    w = F.col("_w")
    last = F.greatest(F.size(w) - rule.length, F.lit(0))
    return (
        items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), words_of(text_or_empty(text)).alias("_w"))
        .where(F.size("_w") > 0)
        .select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i + 1, rule.length))).alias("window"))
        .distinct()
    )


def _shingle_at(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from a place (from 0)."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def _window_shingles(windows: DataFrame, rule: Windows) -> DataFrame:
    """(window, size, offset, token): shingles of each window; a window shorter than a shingle is one itself."""
    parts = []
    for size in range(1, rule.shingle + 1):
        fits = F.size("window") >= size if size == rule.shingle else F.size("window") == size
        parts.append(
            windows.where(fits)
            .select("window", F.explode(F.sequence(F.lit(0), F.size("window") - size)).alias("offset"))
            .select("window", F.lit(size).alias("size"), "offset", _shingle_at(F.col("window"), F.col("offset"), size).alias("token"))
        )
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def _document_shingles(docs: DataFrame, size: int, *columns: str) -> DataFrame:
    """(columns, place, token) of every shingle of a size in every document."""
    return (
        docs.where(F.size("words") >= size)
        .select(*columns, "words", F.posexplode("words").alias("place", "_first"))
        .where(F.col("place") <= F.size("words") - size)
        .select(*columns, "words", "place", _shingle_at(F.col("words"), F.col("place"), size).alias("token"))
    )


def _prefixes(docs: DataFrame, shingles: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """(window, size, offset, token): the rarest shingle of each window; ties go to the least hash, then leftmost."""
    wanted = shingles.select("token").distinct()
    counts = None
    for size in sizes:
        seen = _document_shingles(docs, size).select("token")
        if small:
            seen = seen.join(F.broadcast(wanted), "token")
        part = seen.groupBy("token").agg(F.count("*").alias("times"))
        counts = part if counts is None else counts.unionByName(part)
    rank = F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token", "offset", "size")
    best = shingles.join(counts, "token", "left").groupBy("window").agg(F.min(rank).alias("rarest"))
    # A window whose rarest shingle never occurs cannot occur.
    return best.select("window", "rarest.*").where("times > 0").drop("times")


def occurrences(docs: DataFrame, items: DataFrame, rule: Windows = Windows()) -> DataFrame:
    """(row_id, row_hash, place, window): places of item windows in documents, which carry their row keys.

    ``docs`` needs ``row_id``, ``row_hash`` and ``words`` and should be written; ``items`` is (item, window).
    """
    windows = items.select("window").distinct()
    shingles = stage(_window_shingles(windows, rule), "item-shingles")
    sizes = [r["size"] for r in shingles.select("size").distinct().collect()]  # at most ``rule.shingle`` rows
    small = shingles.limit(rule.broadcast_rows + 1).count() <= rule.broadcast_rows
    keys = ["row_id", "row_hash"]
    start = F.col("place") - F.col("offset")
    inside = (start >= 0) & (start + F.size("window") <= F.size("words"))
    equal = F.slice("words", start + 1, F.size("window")) == F.col("window")
    found = docs.where("false").select(*keys, F.lit(0).alias("place"), "words").withColumnRenamed("words", "window")
    if not sizes:
        return found
    prefixes = stage(_prefixes(docs, shingles, sizes, small), "item-prefixes")
    for size in sizes:
        mine = prefixes.where(F.col("size") == size).drop("size")
        seen = _document_shingles(docs, size, *keys)
        if small:
            places = seen.join(F.broadcast(mine), "token").where(inside & equal)
        else:
            meet = seen.drop("words").join(mine, "token").where(start >= 0)
            places = meet.join(docs.dropDuplicates(keys), keys).where(inside & equal)
        found = found.unionByName(places.select(*keys, start.alias("place"), "window"))
    return found


def _covered(spans: Column) -> Column:
    """Number of words in the union of sorted (place, end) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["place"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def contamination(
    docs: DataFrame, items: DataFrame, rule: Windows = Windows(), id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted ids of the items with windows in it) and spans of hit places."""
    keys = ["row_id", "row_hash"]
    listed = stage(item_windows(items, rule), "item-windows")
    words = stage(
        with_row_key(docs, id_column, text)
        .select(F.col(id_column), *keys, words_of(text_or_empty(text)).alias("words"))
        .withColumn("n_words", F.size("words").cast("long")),
        "document-words",
    )
    found = stage(occurrences(words.drop(id_column), listed, rule), "occurrences")
    span = F.struct(F.col("place"), (F.col("place") + F.size("window")).alias("end"))
    places = found.groupBy(*keys).agg(F.sort_array(F.collect_set(span)).alias("spans"))
    # Which windows a document has is settled before their items, which may be many, are looked up.
    names = F.broadcast(listed) if listed.limit(rule.broadcast_rows + 1).count() <= rule.broadcast_rows else listed
    present = found.select(*keys, "window").distinct().join(names, "window")
    which = present.groupBy(*keys).agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = places.join(which, keys)
    return words.select(id_column, *keys, "n_words").join(hits, keys, "left").select(
        id_column,
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<place:int,end:int>>")).alias("spans"),
    )
