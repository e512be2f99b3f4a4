"""Spelling variants of the words of a corpus: k-d trees over letter counts, one edit at a time.

A word is a vector of letter counts. One replaced letter raises one count by 1 and lowers another by 1, one
inserted letter raises one count by 1: the L1 distance is two at most, and how it splits into rises and
falls is known for each pair of lengths. So for words of equal length a range search allows one rise and
one fall, for the next length one rise, and a box of a k-d tree that would need more is passed over. What
is left is verified letter by letter.

Letters are folded into ``DIMENSIONS`` groups (the commonest ones stay alone), which only lowers distances.

* The words of each length are dealt into cells by the upper levels of a k-d tree. Its planes come from a
  bounded sample (``SAMPLE_ROWS`` words); any planes give the same pairs, they only balance the cells.
* Each word goes to its own cell, and as a query to all cells of its own and the next length that its
  range meets. A task builds the lower levels of the tree over the words of one cell at a time and streams
  the queries in batches, so memory is bounded by a cell.
* Pairs are not shuffled: for each word a cell returns the number of near words and the best of them.

Words of one cell that have the same letters cannot be parted by any plane; such a cell stays whole.

Defined results: a null text has no words and a null id is the empty string; repeated rows count as often
as they occur; ties between near words go to the first in code-point order; an empty table, or one
without a word that is long and frequent enough, gives no rows. Other columns are not read. The chain of
forms ends, as each form is at least ``factor`` (2 or more) times as frequent as the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
DIMENSIONS = 16
# Counts above this are told apart by the letters themselves only.
LEVELS = 4
CELL = 16_384
LEAF = 48
QUERIES = 4_096
SAMPLE_ROWS = 200_000
SAME, LONGER = 1, 2


@dataclass(frozen=True)
class Rule:
    """Which words are looked at, and how much more frequent a form must be."""

    min_length: int = 7
    min_count: int = 2
    factor: int = 10
    cell: int = CELL

    def __post_init__(self):
        if self.factor < 2 or self.min_length < 1:
            raise ValueError("the factor must be 2 or more and the length 1 or more")


def runs(docs: DataFrame, rule: Rule = Rule(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, word): maximal runs of Latin letters, A-Z lower-cased, that are long enough."""
    found = F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    return docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("word")
    ).where(F.length("word") >= rule.min_length)


def with_typos(found: DataFrame) -> DataFrame:
    """A fixed way to damage words: crc32(``doc:word``) decides which one loses which letter."""
    code = F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary"))
    at = (code % F.length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return found.withColumn("word", F.when(code % 31 == 0, less).otherwise(F.col("word")))


def vocabulary(found: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(word, size, n): different words as one byte a letter, their length and how often they occur."""
    counts = found.groupBy("word").agg(F.count("*").alias("n"))
    kept = counts.where((F.col("n") >= rule.min_count) & (F.length("word") >= rule.min_length))
    return kept.select(F.encode("word", "ISO-8859-1").alias("word"), F.length("word").alias("size"), "n")


# --- trees -------------------------------------------------------------------------------


class Tree:
    """A k-d tree over count vectors: planes (``y <= value`` to the left) down to groups of points."""

    def __init__(self, points: np.ndarray, most: float):
        self.planes: list[tuple[int, int, int, int]] = []
        self.groups: list[np.ndarray] = []
        self.root = self._build(points, np.arange(len(points)), most)

    def _build(self, points: np.ndarray, rows: np.ndarray, most: float) -> int:
        if len(rows) > most:
            mine = points[rows]
            value = np.sort(mine, axis=0)[(len(rows) - 1) // 2]
            # A plane below the least or at the largest value parts nothing.
            value = np.minimum(value, mine.max(axis=0) - 1)
            left = (mine <= value).sum(axis=0)
            dim = int(np.abs(2 * left - len(rows)).argmin())
            if 0 < left[dim] < len(rows):
                low = mine[:, dim] <= value[dim]
                number = len(self.planes)
                self.planes.append((dim, int(value[dim]), 0, 0))
                down = self._build(points, rows[low], most)
                self.planes[number] = (dim, int(value[dim]), down, self._build(points, rows[~low], most))
                return number
        self.groups.append(rows)
        return -len(self.groups)

    def meet(self, vectors: np.ndarray, rises: int, falls: int) -> Iterator[tuple[int, np.ndarray]]:
        """(group, rows of the vectors whose range meets its box): at most ``rises`` + 1 and ``falls`` - 1 steps."""
        rows = np.arange(len(vectors))
        open_ = [(self.root, rows, vectors, np.full(len(rows), rises), np.full(len(rows), falls))]
        while open_:
            node, rows, at, up, down = open_.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            dim, value, left, right = self.planes[node]
            x = at[:, dim]
            for child, inside, step, budget in (
                (left, x <= value, -1, (x == value + 1) & (down > 0)),
                (right, x > value, 1, (x == value) & (up > 0)),
            ):
                keep = inside | budget
                moved = budget[keep]
                near = at[keep]
                near[moved, dim] += step
                used = moved.astype(up.dtype)
                rest_up, rest_down = up[keep], down[keep]
                if step > 0:
                    rest_up = rest_up - used
                else:
                    rest_down = rest_down - used
                open_.append((child, rows[keep], near, rest_up, rest_down))


def letters_of(words: pa.Array, size: int) -> np.ndarray:
    """The letters of words of one length as a matrix of bytes."""
    start = words.offset
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + 1, offset=4 * start)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(len(words), size)


def count_vectors(letters: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """How often each folded letter stands in each word."""
    rows = np.arange(len(letters))[:, None] * DIMENSIONS
    flat = np.bincount((rows + fold[letters]).ravel(), minlength=len(letters) * DIMENSIONS)
    return flat.reshape(len(letters), DIMENSIONS).astype(np.int32)


def signatures(vectors: np.ndarray) -> np.ndarray:
    """Counts in unary, up to LEVELS: the number of different bits is at most the L1 distance."""
    bits = np.minimum(vectors, LEVELS)[:, :, None] > np.arange(LEVELS)
    return np.packbits(bits.reshape(len(vectors), -1), axis=1).view(np.uint64).ravel()


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words of equal length differ in exactly one letter."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the longer word is the shorter one with one letter put in."""
    size = short.shape[1]
    head = np.logical_and.accumulate(short == long[:, :size], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


def near_pairs(
    tree: Tree, members: np.ndarray, member_codes: np.ndarray, queries: np.ndarray, vectors: np.ndarray, kind: int
) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) rows of all words one edit apart; members are as long as queries or one letter longer."""
    codes, verify = signatures(vectors), one_replaced if kind == SAME else one_inserted
    rows_out, members_out = [], []
    for group, rows in tree.meet(vectors, 1, 1 if kind == SAME else 0):
        mine = tree.groups[group]
        limit = 2 if kind == SAME else 1
        step = max(1, (1 << 21) // len(mine))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            a, b = np.nonzero(np.bitwise_count(codes[some][:, None] ^ member_codes[mine][None, :]) <= limit)
            a, b = some[a], mine[b]
            hit = verify(queries[a], members[b])
            rows_out.append(a[hit])
            members_out.append(b[hit])
    if not rows_out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(rows_out), np.concatenate(members_out)


# --- cells -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cells:
    """The fold of letters into groups, and the upper tree of each length that has more words than a cell."""

    fold: np.ndarray
    trees: dict[int, Tree]


def _fold(letters: list[tuple[int, int]]) -> np.ndarray:
    """The commonest letters alone in a group, the rest joined to the groups that are least filled."""
    fold, load = np.zeros(256, dtype=np.int64), [0] * DIMENSIONS
    for letter, n in sorted(letters, key=lambda x: (-x[1], x[0])):
        group = load.index(min(load))
        fold[letter] = group
        load[group] += n
    return fold


def fit_cells(words: DataFrame, rule: Rule) -> Cells:
    """Folding and upper trees; at most SAMPLE_ROWS words, 256 letters and a count per large length reach the driver."""
    large = words.groupBy("size").count().where(F.col("count") > rule.cell).collect()
    some = words
    share = 1.0
    total = sum(r["count"] for r in large)
    if total > SAMPLE_ROWS:
        share = SAMPLE_ROWS / total
        some = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    letter = F.explode(F.split(F.decode("word", "ISO-8859-1"), "")).alias("letter")
    letters = [
        (ord(r["letter"]), r["n"]) for r in some.select(letter).where("letter != ''").groupBy("letter").agg(F.count("*").alias("n")).collect()
    ]
    fold, trees = _fold(letters), {}
    sizes = {r["size"]: r["count"] for r in large}
    sample: dict[int, list[bytes]] = {}
    if sizes:
        for r in some.where(F.col("size").isin(*sizes)).select("size", "word").orderBy("size", "word").limit(2 * SAMPLE_ROWS).collect():
            sample.setdefault(r["size"], []).append(bytes(r["word"]))
    for size, mine in sample.items():
        points = count_vectors(letters_of(pa.array(mine, pa.binary()), size), fold)
        trees[size] = Tree(points, rule.cell * len(mine) / sizes[size])
        trees[size].groups = []  # only the planes travel
    return Cells(fold, trees)


_SEARCH = pa.schema([("cell", pa.int64()), ("kind", pa.int32()), ("size", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])


def _cell(size: int, group: int) -> int:
    return size << 32 | group


def _dealt(cells: Cells) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each word to its own cell (kind 0), and to the cells that its ranges meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == size))
                words, n = batch.column("word").take(at), batch.column("n").take(at)
                vectors = count_vectors(letters_of(words, size), cells.fold)
                for kind, length, rises, falls in ((0, size, 0, 0), (SAME, size, 1, 1), (LONGER, size + 1, 1, 0)):
                    tree = cells.trees.get(length)
                    found = [(0, np.arange(len(words)))] if tree is None else tree.meet(vectors, rises, falls)
                    for group, rows in found:
                        for i in range(0, len(rows), QUERIES):
                            some = pa.array(rows[i : i + QUERIES])
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(len(some), _cell(length, group))),
                                    pa.array(np.full(len(some), kind, dtype=np.int32)),
                                    pa.array(np.full(len(some), size, dtype=np.int32)),
                                    words.take(some),
                                    n.take(some),
                                ],
                                schema=_SEARCH,
                            )

    return run


_FOUND = pa.schema(
    [("word", pa.binary()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.binary())]
)


def _order(letters: np.ndarray) -> np.ndarray:
    """Rank of each word in code-point order."""
    rank = np.empty(len(letters), dtype=np.int64)
    rank[np.lexsort(letters.T[::-1])] = np.arange(len(letters))
    return rank


def _best(own: np.ndarray, other: np.ndarray, words: pa.Array, n: np.ndarray, others: pa.Array, other_n: np.ndarray, rank: np.ndarray):
    """A row for every word that has near words: their number, and the most frequent (first) one."""
    order = np.lexsort((rank[other], -other_n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    much = np.diff(first, append=len(own))
    return pa.RecordBatch.from_arrays(
        [
            words.take(pa.array(own[first])),
            pa.array(n[own[first]]),
            pa.array(much),
            pa.array(other_n[other[first]]),
            others.take(pa.array(other[first])),
        ],
        schema=_FOUND,
    )


def _searched(fold: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Near words inside cells; rows are sorted by cell, its own words first."""

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)]):
                for i in range(a, b, QUERIES):
                    yield batch.slice(i, min(QUERIES, b - i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, gathered, built = None, [], None
        for part in runs_of(b for b in batches if b.num_rows):
            number, kind, size = (part.column(c)[0].as_py() for c in ("cell", "kind", "size"))
            if number != cell:
                cell, gathered, built = number, [], None
            if kind == 0:
                gathered.append(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("word"),
                        part.column("n"),
                        pa.array(np.zeros(part.num_rows, dtype=np.int64)),
                        pa.nulls(part.num_rows, pa.int64()),
                        pa.nulls(part.num_rows, pa.binary()),
                    ],
                    schema=_FOUND,
                )
                continue
            if not gathered:
                continue  # no word of that length
            if built is None:
                words = pa.concat_arrays([g.column("word") for g in gathered])
                n = np.concatenate([g.column("n").to_numpy() for g in gathered])
                letters = letters_of(words, number >> 32)
                vectors = count_vectors(letters, fold)
                built = words, n, letters, signatures(vectors), Tree(vectors, LEAF), _order(letters)
            words, n, letters, codes, tree, rank = built
            mine, mine_n = part.column("word"), part.column("n").to_numpy()
            asked = letters_of(mine, size)
            rows, members = near_pairs(tree, letters, codes, asked, count_vectors(asked, fold), kind)
            if len(rows):
                yield _best(rows, members, mine, mine_n, words, n, rank)
                if kind == LONGER:
                    yield _best(members, rows, words, n, mine, mine_n, _order(asked))

    return run


def near_words(words: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(word, n, n_near, best_n, best): for every word of a written vocabulary its near words and the most frequent one."""
    cells = fit_cells(words, rule)
    dealt = words.mapInArrow(_dealt(cells), "cell bigint, kind int, size int, word binary, n bigint")
    sorted_ = dealt.repartition("cell").sortWithinPartitions("cell", "kind")
    found = sorted_.mapInArrow(_searched(cells.fold), "word binary, n bigint, n_near bigint, best_n bigint, best binary")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    return (
        found.groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
        .select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))
    )


def _text(column: Column | str) -> Column:
    return F.decode(column, "ISO-8859-1")


def variants(words: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of a vocabulary."""
    words = stage(words, "vocabulary")
    formed = F.col("best_n") >= rule.factor * F.col("n")
    near = stage(
        near_words(words, rule).select(
            "word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
        ),
        "near-words",
    )
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    # Each step multiplies n by the factor at least, so the steps are few; each round doubles what it follows.
    most, steps = near.agg(F.max("n")).first()[0] or 0, 0
    while most >= rule.factor * rule.min_count:
        most, steps = most // rule.factor, steps + 1
    for _ in range(max(steps - 1, 0).bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stage(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return near.join(links, "word", "left").select(
        _text("word").alias("word"),
        _text("form").alias("form"),
        _text(F.coalesce("root", "word")).alias("root"),
        "n",
        "n_near",
        "form_n",
    )
