"""Exact Jaccard join of word n-gram sets: size bands, hashed signatures, bitmap bounds, components.

Documents with equal sets are one *class*. Classes link when their Jaccard similarity reaches the
threshold; the result is the component of every document, not its pairs.

1. Size bands: sets that link differ in size by at most the threshold, so they lie in one band or in
   two adjacent ones. A tile is two adjacent bands. Two linked sets of a tile differ in at most d
   elements; cut by hash into m > d parts, they agree in at least m - d of them. Each class emits a
   hash of every part for its two tiles, and classes that meet nowhere cannot link. A part holds about
   six n-grams, so frequent n-grams bring nobody together who does not share most of a set.
2. In each meeting place, the least class (its centre) is compared with the others (a star).
3. Where the stars leave more than one component in a place, all pairs of different components that
   meet there are compared. A class leaves its most crowded places out: linked sets agree in m - d
   parts at least, so they also meet in one that is not among the m - d - 1 most crowded of either.
   Places with the same centre are one tile, so that a class is sent once for many places; the rows of
   all tiles are at most those of the places. A crowded tile is cut into blocks.
4. Both comparisons run in two steps. First only bitmaps travel, in step 3 with the places: elements
   in bits that the other set has not are not shared, which bounds the overlap from above. Then texts
   are sent to the tiles in which some pair may reach the threshold, those of such pairs only, and
   their sorted arrays are intersected.

So no link between different texts is lost, and dense groups cost their stars only.

Defined results: a null text, or one without words, has an empty set and links with nothing; fewer
words than n form one element; repeated rows are one class and one component. Rows with a null id
belong to the component of their class, whose id is the least id in it that is not null. An empty
table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.anchors import MULTIPLIER, mix, word_hashes
from emberlog.llm.common import bucket_count, packed_rows, text_or_empty, with_row_key
from emberlog.llm.components import components
from emberlog.session import stage

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = 2_048
# The mark of an empty part in which sets may agree; those of other parts are less.
EMPTY = 65_535
# Elements of all sets that the tile of a star should hold; larger tiles send a text to fewer of them.
TILE_ELEMENTS = 1_000_000
# So many times more in a tile of meeting places, in which few pairs need their texts.
WIDER = 4


@dataclass(frozen=True)
class Join:
    """n of the n-grams, and the threshold in percent."""

    n: int = 4
    percent: int = 85

    @functools.cached_property
    def edges(self) -> np.ndarray:
        """Least size of every band; a size and the largest that can link with it are at most one band apart."""
        low = [1]
        while low[-1] < 2**40:
            low.append(low[-1] * 100 // self.percent + 1)
        return np.array(low, dtype=np.int64)

    def parts(self, tile: int) -> tuple[int, int]:
        """(m, d) of a tile: the number of parts and the most elements in which linked sets differ."""
        size = int(self.edges[tile + 2]) - 1
        d = 2 * size * (100 - self.percent) // (100 + self.percent)
        return d + 3 + d // 16, d

    def links(self, a: int, b: int, shared: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)


def elements(text: str, n: int) -> np.ndarray:
    """The sorted set of hashed n-grams of a text."""
    units = word_hashes(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not len(units):
        return units
    width = min(n, len(units))
    value = np.zeros(len(units) - width + 1, dtype=np.uint64)
    for i in range(width):
        value = value * np.uint64(MULTIPLIER) + units[i : len(units) - width + 1 + i]
    return np.unique(mix(value + np.uint64(width)))


def set_print(found: np.ndarray) -> int:
    """A 64-bit print of a set."""
    return int(mix(np.array([np.sum(mix(found)) + np.uint64(len(found))], dtype=np.uint64)).view(np.int64)[0])


def tiles_of(size: int, join: Join) -> range:
    """The one or two tiles that sets of this size are in."""
    band = int(np.searchsorted(join.edges, size, side="right")) - 1
    return range(max(band - 1, 0), band + 1)


def part_sums(found: np.ndarray, weights: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the weights and the number of every part, of m, that is not empty."""
    # Parts are ranges of the hash, so the sorted set is cut, not dealt.
    part = ((found >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
    return np.add.reduceat(weights, starts), part[starts].astype(np.uint64)


def signatures(found: np.ndarray, join: Join) -> np.ndarray:
    """The hashes under which a class meets others: one for each part of its two tiles.

    The last bit of a hash tells the two tiles apart.
    """
    weights = mix(found)
    out = []
    for tile in tiles_of(len(found), join):
        m, d = join.parts(tile)
        if not d:  # only equal sets link, and they are one class
            continue
        sums, places = part_sums(found, weights, m)
        if m - len(places) >= m - d:  # sets may agree in empty parts only
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), places)
            sums, places = np.append(sums, np.zeros(len(empty), np.uint64)), np.append(places, empty)
        seed = np.uint64((tile + 1) * MULTIPLIER & (2**64 - 1))
        found_at = mix(mix(sums + places) + places * np.uint64(0xD6E8FEB86659FD93) + seed)
        out.append(found_at & ~np.uint64(1) | np.uint64(tile & 1))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def short_marks(found: np.ndarray, join: Join, tile: int) -> np.ndarray:
    """16 bits for each part of a tile: 0 is an empty part that does not count, EMPTY one that does.

    Sets that link have equal marks other than 0 in some part, like equal signatures.
    """
    m, d = join.parts(tile)
    marks = np.zeros(m if d else 0, dtype=np.uint16)
    if not d or not len(found):
        return marks
    sums, places = part_sums(found, mix(found), m)
    if m - len(places) >= m - d:
        marks[:] = EMPTY
    marks[places.astype(np.int64)] = mix(sums + places) % np.uint64(EMPTY - 1) + np.uint64(1)
    return marks


def spare_places(found: np.ndarray, join: Join, tile: int) -> int:
    """How many of its places in a tile a set may leave out, if all sets leave out their most crowded ones.

    Linked sets agree in m - d parts. Those that are empty in both have no place, so at least as many
    places are left as this number and one.
    """
    marks = short_marks(found, join, tile)
    if not len(marks) or (marks == EMPTY).any():
        return 0
    m, d = join.parts(tile)
    return m - d - 1 - int((marks == 0).sum())


CLASSES = "row_id long, row_hash long, size long, class long"


def document_classes(keyed: DataFrame, join: Join) -> DataFrame:
    """(row_id, row_hash, size, class) of every row; equal sets have equal classes."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [elements(t.as_py(), join.n) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([set_print(x) for x in sets], pa.int64()),
                ],
                names=["row_id", "row_hash", "size", "class"],
            )

    return keyed.select("row_id", "row_hash", "text").mapInArrow(describe, CLASSES)


def meeting_places(keyed: DataFrame, join: Join, rows: int) -> DataFrame:
    """``place, class, centre, crowd`` of the places where classes meet, each class once.

    The centre is the least class of a place, the crowd the number of its classes.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies in one partition of the input emit their places once.
        known: set[int] = set()
        for batch in batches:
            places, owners, size = [], [], 0
            for text in batch.column(2):
                found = elements(text.as_py(), join.n)
                one = set_print(found)
                if not len(found) or one in known:
                    continue
                known.add(one)
                mine = signatures(found, join)
                places.append(mine)
                owners.append(np.full(len(mine), one, dtype=np.int64))
                size += len(mine)
                if size > 500_000:
                    yield _table(["place", "class"], np.concatenate(places), np.concatenate(owners))
                    places, owners, size = [], [], 0
            if size:
                yield _table(["place", "class"], np.concatenate(places), np.concatenate(owners))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        places, owners = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((owners, places))
        places, owners = places[order], owners[order]
        # Copies in different partitions of the input.
        first = np.concatenate([[True], (places[1:] != places[:-1]) | (owners[1:] != owners[:-1])])
        places, owners = places[first], owners[first]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
        sizes = np.diff(np.append(starts, len(places)))
        crowds, centres = np.repeat(sizes, sizes), np.repeat(owners[starts], sizes)
        met = crowds > 1
        columns = [x[met] for x in (places, owners, centres, crowds)]
        for low in range(0, len(columns[0]), 100_000):
            yield _table(["place", "class", "centre", "crowd"], *(x[low : low + 100_000] for x in columns))

    met = keyed.select("row_id", "row_hash", "text").mapInArrow(emit, "place long, class long")
    # About half a million rows for each task, whatever the size of the table.
    tasks = max(24, bucket_count(rows, 2_048))
    return met.repartition(tasks, "place").mapInArrow(meet, "place long, class long, centre long, crowd long")


def _table(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bitmap of BITS bits per set."""
    maps = np.zeros((len(sets), BITS), dtype=bool)
    for row, found in zip(maps, sets, strict=True):
        row[(found % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(maps, axis=1).view(np.uint64)


class Meetings:
    """Which sets of a tile have a mark in common; sets that link always do."""

    def __init__(self, marks: list[np.ndarray]):
        places = np.concatenate(marks)
        owners = np.repeat(np.arange(len(marks)), [len(x) for x in marks])
        order = np.argsort(places, kind="stable")
        places, owners = places[order], owners[order]
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1], [True]]))) if len(places) else []
        shared = np.repeat(sizes, sizes) > 1 if len(places) else np.zeros(0, dtype=bool)
        self.members = owners[shared]
        kept = np.asarray(sizes)[np.asarray(sizes) > 1] if len(places) else np.zeros(0, dtype=np.int64)
        self.ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
        group = np.repeat(np.arange(len(kept)), kept)
        by_owner = np.argsort(self.members, kind="stable")
        self.groups = group[by_owner]
        self.first = np.searchsorted(self.members[by_owner], np.arange(len(marks) + 1))

    def of(self, one: int) -> np.ndarray:
        """The sets that meet set ``one``, itself included."""
        groups = self.groups[self.first[one] : self.first[one + 1]]
        if not len(groups):
            return np.zeros(0, dtype=np.int64)
        return np.unique(np.concatenate([self.members[self.ends[g] : self.ends[g + 1]] for g in groups]))


def possible(one: int, others: np.ndarray, sizes: np.ndarray, maps: np.ndarray, join: Join) -> np.ndarray:
    """Those of ``others`` that may link with set ``one`` by their sizes and bitmaps."""
    size = sizes[one]
    fits = (100 * np.minimum(sizes[others], size) >= join.percent * np.maximum(sizes[others], size)) & (sizes[others] > 0)
    others = others[fits]
    if not len(others) or not size:
        return others[:0]
    mine, theirs = maps[one], maps[others]
    most = np.minimum(
        size - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64),
        sizes[others] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64),
    )
    return others[100 * most >= join.percent * (size + sizes[others] - most)]


def linked(one: int, others: np.ndarray, sets: list, sizes: np.ndarray, maps: np.ndarray, join: Join) -> list[int]:
    """Those of ``others`` that link with set ``one``."""
    found = []
    for k in possible(one, others, sizes, maps, join):
        shared = len(np.intersect1d(sets[one], sets[k], assume_unique=True))
        if join.links(int(sizes[one]), int(sizes[k]), shared):
            found.append(int(k))
    return found


OUTLINES = "class long, size long, map binary, spare_even int, spare_odd int"


def outlines(texts: DataFrame, join: Join) -> DataFrame:
    """What the first step needs of a class: size, bitmap, and the places to spare in its tiles of even and odd number.

    A bitmap has at least two bits for an element, a power of two of them, so that wide ones fold to
    narrow ones.
    """

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, text in zip(batch.column(0), batch.column(1), strict=True):
                found = elements(text.as_py(), join.n)
                bits = np.zeros(max(512, 1 << (2 * len(found) - 1).bit_length()), dtype=bool)
                bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)] = True
                spare = {tile & 1: spare_places(found, join, tile) for tile in tiles_of(len(found), join)}
                rows.append((one.as_py(), len(found), np.packbits(bits).tobytes(), spare.get(0, 0), spare.get(1, 0)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "size", "map", "spare_even", "spare_odd"])

    return texts.select("class", "text").mapInArrow(outline, OUTLINES)


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of different widths as rows of the least width."""
    width = min(len(x) for x in maps)
    rows = [np.bitwise_or.reduce(np.frombuffer(x, dtype=np.uint8).reshape(-1, width), axis=0) for x in maps]
    return np.stack(rows).view(np.uint64)


def _rows(batch: pa.RecordBatch) -> list[dict]:
    """The rows of a batch; places stay arrays."""
    if "places" not in batch.schema.names:
        return batch.to_pylist()
    places = batch.column("places")
    ends = np.cumsum(places.value_lengths().to_numpy())
    rows = batch.drop_columns(["places"]).to_pylist()
    for row, own in zip(rows, np.split(places.flatten().to_numpy(), ends[:-1]), strict=True):
        row["places"] = own
    return rows


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each tile; rows of one tile follow each other."""
    held: list[dict] = []
    for batch in batches:
        for row in _rows(batch) if batch.num_rows else ():
            if held and row["tile"] != held[0]["tile"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


CANDIDATES = "class long, tile long, role int, label long"


def _tile_candidates(join: Join):
    """The rows of tiles that may link with some row of another label there."""

    def screen(rows: list[dict]) -> list[dict]:
        sizes = np.array([r["size"] for r in rows], dtype=np.int64)
        maps = folded([r["map"] for r in rows])
        role = np.array([r["role"] for r in rows])
        names: dict[int, int] = {}
        label = np.array([names.setdefault(r["label"], i) for i, r in enumerate(rows)])
        centres = np.flatnonzero(role == 0)
        members = np.flatnonzero(role == 1)
        meetings = None if len(centres) else Meetings([r["places"] for r in rows])
        hit = np.zeros(len(rows), dtype=bool)
        for one in centres if len(centres) else range(len(rows)):
            if len(centres):
                others = members
            else:
                others = meetings.of(int(one))
                others = others[(others > one) & ((role[others] != role[one]) | (role[one] == 4))]
            others = possible(int(one), others[label[others] != label[one]], sizes, maps, join)
            hit[others] = True
            hit[one] |= len(others) > 0
        return [rows[i] for i in np.flatnonzero(hit)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_tile(batches):
            if found := screen(rows):
                kinds = {"class": pa.int64(), "tile": pa.int64(), "role": pa.int32(), "label": pa.int64()}
                columns = [pa.array([r[name] for r in found], kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    return work


def _tile_links(join: Join):
    """Links inside tiles: of centres (role 0) with the rest, or of all pairs with different labels.

    Only the links that join two parts of the tile are returned, so a tile of k classes gives fewer
    than k links.
    """

    def settle(rows: list[dict]) -> list[tuple[int, int]]:
        sets = [elements(r["text"], join.n) for r in rows]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        maps = bitmaps(sets)
        label = {}
        parent = np.array([label.setdefault(r["label"], i) for i, r in enumerate(rows)])
        out = []
        centres = [i for i in range(len(rows)) if rows[i]["role"] == 0]
        block = np.array([r["role"] for r in rows])
        none = np.zeros(0, dtype=np.int64)
        meetings = None if centres else Meetings([signatures(x, join) if len(x) else none for x in sets])
        for one in centres or range(len(rows)):
            if centres:
                others = np.flatnonzero(block == 1)
            else:
                others = meetings.of(one)
                # Two different blocks meet here (roles 2 and 3), or one block with itself (role 4).
                others = others[(others > one) & ((block[others] != block[one]) | (block[one] == 4))]
            others = others[parent[others] != parent[one]]
            for k in linked(int(one), others, sets, sizes, maps, join):
                if parent[k] != parent[one]:
                    out.append((rows[one]["class"], rows[k]["class"]))
                    parent[parent == parent[k]] = parent[one]
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _by_tile(batches):
            out += settle(rows)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return work


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _dealt(places: DataFrame, what: DataFrame) -> DataFrame:
    """The columns of a class, fetched once, in each of its tiles; rows of a tile follow each other."""
    at = [c for c in places.columns if c != "class"]
    wanted = places.groupBy("class").agg(F.collect_list(F.struct(*at)).alias("at"))
    sent = what.join(wanted, "class").withColumn("at", F.explode("at")).select(*what.columns, "at.*")
    return sent.repartition("tile").sortWithinPartitions("tile", "role", "class")


def _compare(places: DataFrame, known: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) found in tiles; ``places`` has class, tile, role and label, and in which places of the tile to meet.

    Outlines go to all tiles, texts to those in which they may link.
    """
    few = _dealt(places, known.select("class", "size", "map"))
    few = stage(few.mapInArrow(_tile_candidates(join), CANDIDATES), "join-candidates")
    dealt = _dealt(few, texts).select("tile", "role", "label", "class", "text")
    return dealt.mapInArrow(_tile_links(join), "a long, b long")


def _star_places(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tiles of the stars: a centre and a bounded share of its members."""
    weighed = pairs.join(sizes.select(F.col("class").alias("b"), "size"), "b")
    total = weighed.groupBy("a").agg(F.sum("size").alias("_total"))
    cut = weighed.join(total, "a").select(
        "a", "b", F.ceil(F.col("_total") / TILE_ELEMENTS).alias("_shares")
    ).withColumn("tile", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("_shares"))))
    members = cut.select(F.col("b").alias("class"), "tile", F.lit(1).alias("role"), F.col("b").alias("label"))
    centres = cut.select("a", "tile").distinct()
    return members.union(centres.select(F.col("a").alias("class"), "tile", F.lit(0).alias("role"), F.col("a").alias("label")))


def _open_places(places: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles of the places that one centre has, for classes with different labels; large ones are cut into blocks."""
    odd = F.col("place") % 2 != 0
    crowded = Window.partitionBy("class", "odd").orderBy(F.desc("crowd"), F.desc("place"))
    spare = F.when(F.col("odd"), F.col("spare_odd")).otherwise(F.col("spare_even"))
    found = (
        places.withColumn("odd", odd)
        .join(known.select("class", "size", "spare_even", "spare_odd"), "class")
        .withColumn("_rank", F.row_number().over(crowded))
        .where(F.col("_rank") > spare)
        .groupBy("centre", "odd", "class")
        .agg(F.first("size").alias("size"), F.collect_list("place").alias("places"))
        .join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
        .withColumn("label", F.coalesce("component", "class"))
        .drop("component")
    )
    found = stage(found, "join-meetings")
    blocks = F.ceil(F.sum("size") * 2 / (WIDER * TILE_ELEMENTS)).alias("blocks")
    totals = found.groupBy("centre", "odd").agg(blocks, F.min("label").alias("_low"), F.max("label").alias("_high"))
    totals = totals.where("_low != _high").select("centre", "odd", "blocks")
    cut = found.join(totals, ["centre", "odd"]).withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")))
    block = F.col("block")
    grid = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(
            F.xxhash64("centre", "odd", F.least(block, other), F.greatest(block, other)).alias("tile"),
            F.when(other == block, 4).when(block < other, 2).otherwise(3).alias("role"),
        ),
    )
    return cut.select("class", "label", "places", F.explode(grid).alias("at")).select("class", "at.*", "label", "places")


def linked_classes(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """(row_id, row_hash, size, class) of every row, and (node, component) of every linked class."""
    keyed = with_row_key(docs).select("row_id", "row_hash", text_or_empty().alias("text"))
    classes = stage(document_classes(keyed, join), "join-classes")
    rows = classes.count()
    places = stage(meeting_places(keyed, join, rows), "join-places")
    pairs = places.where("class != centre").select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct()
    pairs = stage(pairs, "join-stars")
    # One row stands for a class.
    sizes = classes.groupBy("class").agg(F.min(F.struct("row_id", "row_hash")).alias("one"), F.first("size").alias("size"))
    sizes = stage(sizes.select("class", "size", "one.*"), "join-sizes")
    meeting = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    # Repeated rows share their key: one text per class is enough.
    candidates = sizes.join(meeting, "class").select("class", "row_id", "row_hash")
    texts = keyed.join(candidates, ["row_id", "row_hash"]).select("class", "text").dropDuplicates(["class"])
    texts = stage(texts, "join-texts")

    known = stage(outlines(texts, join), "join-outlines")
    links = stage(_compare(_star_places(pairs, sizes), known, texts, join), "join-links")
    labels = components(links, "join-first")
    label = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"l{side}"))
    # A place with two labels has one that is not its centre's.
    unsettled = (
        pairs.join(label("a"), "a", "left")
        .join(label("b"), "b", "left")
        .where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
        .select(F.col("a").alias("centre"))
        .distinct()
    )
    unsettled = stage(unsettled, "join-open")
    if unsettled.isEmpty():
        return classes, labels
    meetings = _open_places(places.join(unsettled, "centre"), known, labels)
    more = stage(_compare(meetings, known, texts, join), "join-more-links")
    if more.isEmpty():
        return classes, labels
    return classes, components(links.union(more), "join-last")


def components_of(docs: DataFrame, join: Join = Join(), id_column: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the least id in its component)."""
    slim = docs.select(F.col(id_column).alias("doc_id"), "text")
    classes, labels = linked_classes(slim, join)
    null_id = -(2**63)
    named = classes.withColumn("doc_id", F.when(F.col("row_id") != null_id, F.col("row_id")))
    # Documents with an empty set link with nothing: each is its own component.
    found = named.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("component", "class")).alias("_component")
    )
    least = found.where("n_shingles > 0").groupBy("_component").agg(F.min("doc_id").alias("_least"))
    return found.join(least, "_component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The first document (least id, null last, then text hash) of each component; columns as they came.

    Documents without words are kept. Of repeated rows one stays.
    """
    classes, labels = linked_classes(docs.select("doc_id", "text"), join)
    place = F.struct((F.col("row_id") == -(2**63)).alias("unnamed"), "row_id", "row_hash")
    found = classes.where("size > 0").join(labels.withColumnRenamed("node", "class"), "class", "left")
    first = found.groupBy(F.coalesce("component", "class").alias("_c")).agg(F.min(place).alias("one"))
    first = first.select("one.row_id", "one.row_hash")
    keyed = with_row_key(packed_rows(docs))
    empty = classes.where("size = 0").select("row_id", "row_hash").distinct()
    chosen = keyed.join(first.union(empty), ["row_id", "row_hash"])
    # Repeated rows share their key; the words of a row do not tell them apart.
    return chosen.dropDuplicates(["row_id", "row_hash"]).select("row.*")
