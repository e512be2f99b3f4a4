"""Quality rules: word counts, repeated windows and lines, and zstandard compression bands.

A text passes when its compression ratio, as a whole and in every fixed chunk, lies in the band for
its length. Repetitive text compresses too well, random text too badly; short texts compress badly
whatever they say, so the bands depend on the length. The limits are quantiles of the ratios of texts
labelled clean, with a margin (``fitted``).

Defined results: a null text is the empty text, has no words and fails the base rules. Rows are
judged one by one, so repeated rows get the same verdict, and an empty table gives an empty table.
Other columns pass through; a column that already has the name of a result is replaced.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import WORD, text_or_empty

SYMBOL = re.compile(r"[#*$%&|<>]")
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]")


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio (bytes before / after compression).

    ``edges[i]`` is the least number of UTF-8 bytes of band i; ``low`` and ``high`` its limits. Texts of more
    than one chunk have limits of their own for the chunks. The numbers are what ``fitted`` gives for the
    labelled clean rows of sf0.1 whose ``fold`` is 0.
    """

    edges: tuple[int, ...] = (0, 200, 300, 420, 600, 850, 1_200, 1_700, 2_400, 3_400, 4_800, 6_800, 9_600, 14_000)
    low: tuple[float, ...] = (1.0, 1.2, 1.28, 1.38, 1.47, 1.61, 1.68, 1.79, 1.89, 1.97, 2.01, 2.06, 2.08, 2.07)
    high: tuple[float, ...] = (1.62, 1.7, 1.79, 1.87, 1.95, 2.03, 2.09, 2.17, 2.21, 2.29, 2.35, 2.42, 2.47, 2.58)
    chunk_edges: tuple[int, ...] = (0, 5_000, 6_500)
    chunk_low: tuple[float, ...] = (1.98, 2.0, 1.98)
    chunk_high: tuple[float, ...] = (2.27, 2.37, 2.48)
    chunk_bytes: int = 4_096
    level: int = 3

    def holds(self, size: int, ratio: float) -> bool:
        return _inside(self.edges, self.low, self.high, size, ratio)

    def chunk_holds(self, size: int, ratio: float) -> bool:
        return _inside(self.chunk_edges, self.chunk_low, self.chunk_high, size, ratio)


def _inside(edges: tuple[int, ...], low: tuple[float, ...], high: tuple[float, ...], size: int, ratio: float) -> bool:
    band = int(np.searchsorted(edges, size, side="right")) - 1
    return low[band] <= ratio <= high[band]


@dataclass(frozen=True)
class BaseRules:
    """Limits of the base rules; windows are counted in words."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30


METRICS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("chunk_ratio_min", T.DoubleType()),
        T.StructField("chunk_ratio_max", T.DoubleType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def repeated_words(words: list[str], window: int) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the list."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    names = np.fromiter(map(seen.setdefault, words, itertools.count()), dtype=np.int64, count=n)
    # names[i] stands for the words i .. i+width-1; widths double, the last step overlaps.
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = names[:-step] * (n + 1) + names[step:]
        distinct, names = np.unique(pairs, return_inverse=True)
        width += step
        if len(distinct) == len(pairs):
            return 0
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    change = np.zeros(n + 1, dtype=np.int64)
    change[starts] += 1
    np.subtract.at(change, starts + window, 1)
    return int(np.count_nonzero(np.cumsum(change)))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if NON_SPACE.search(x)]
    return len(lines) - len(set(lines))


def ratios(data: bytes, chunk_bytes: int, compressor: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """Ratio of the whole text and (size, ratio) of each chunk; a short rest joins the last chunk."""
    whole = len(data) / len(compressor.compress(data)) if data else 0.0
    count = max(1, len(data) // chunk_bytes)
    if count == 1:
        return whole, [(len(data), whole)]
    starts = [i * chunk_bytes for i in range(count)] + [len(data)]
    parts = [data[a:b] for a, b in itertools.pairwise(starts)]
    return whole, [(len(x), len(x) / len(compressor.compress(x))) for x in parts]


def measure(text: str, rules: BaseRules, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    """One row of METRICS."""
    words = WORD.findall(text)
    repeats = repeated_words(words, rules.window)
    data = text.encode("utf-8", "surrogatepass")
    whole, chunks = ratios(data, bands.chunk_bytes, compressor)
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    kept = not failed and bands.holds(len(data), whole)
    kept = kept and (len(chunks) == 1 or all(bands.chunk_holds(*x) for x in chunks))
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOL.findall(text)),
        repeated_lines(text),
        repeats,
        whole,
        min(x for _, x in chunks),
        max(x for _, x in chunks),
        failed,
        kept,
    )


@functools.lru_cache(maxsize=8)
def _scorer(rules: BaseRules, bands: Bands):
    @F.pandas_udf(METRICS)
    def score(texts: pd.Series) -> pd.DataFrame:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows = [measure(x, rules, bands, compressor) for x in texts]
        return pd.DataFrame(rows, columns=METRICS.names)

    return score


def quality(docs: DataFrame, rules: BaseRules = BaseRules(), bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The documents with the columns of METRICS; ``kept`` is the verdict."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in METRICS.names]
    scored = docs.withColumn("_quality", _scorer(rules, bands)(text_or_empty(text)))
    return scored.select(*others, "_quality.*")


def accepted(docs: DataFrame, rules: BaseRules = BaseRules(), bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return docs.where(_scorer(rules, bands)(text_or_empty(text))["kept"])


# Rows of the sample that limits are fitted to, at most; its ratios come to the driver.
SAMPLE_ROWS = 20_000


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``text, clean, fold`` of the documents with a label; clean needs quality 1 in every label of the id.

    ``fold`` is 0 or 1 by the text, so equal texts are in the same fold.
    """
    marks = labels.groupBy("doc_id").agg((F.min("quality") == 1).alias("clean"))
    return docs.join(marks.where("clean is not null"), "doc_id").select(
        text_or_empty(text).alias("text"), "clean", F.pmod(F.xxhash64(text_or_empty(text)), F.lit(2)).alias("fold")
    )


def fitted(
    clean: DataFrame,
    rules: BaseRules = BaseRules(),
    bands: Bands = Bands(),
    tail: float = 0.005,
    below: float = 0.05,
    above: float = 0.02,
) -> Bands:
    """``bands`` with limits from the texts of ``clean`` that pass the base rules (at most SAMPLE_ROWS of them).

    A limit is the quantile ``tail`` (or 1 - ``tail``) of the ratios in its band, moved outwards by the share
    ``below`` or ``above`` and by 1 / n more, as n ratios say little about the tail if they are few. A band
    without ratios is an error.
    """

    @F.pandas_udf("array<struct<size: long, ratio: double>>")
    def all_ratios(texts: pd.Series) -> pd.Series:
        compressor, rows = zstandard.ZstdCompressor(level=bands.level), []
        for text in texts:
            words, data = WORD.findall(text), text.encode("utf-8", "surrogatepass")
            failed = len(words) < rules.min_words or 100 * repeated_words(words, rules.window) > rules.max_repeat_percent * len(words)
            whole, chunks = (0.0, []) if failed else ratios(data, bands.chunk_bytes, compressor)
            rows.append([] if failed else [(len(data), whole), *(chunks if len(chunks) > 1 else [])])
        return pd.Series([[{"size": n, "ratio": x} for n, x in row] for row in rows])

    measured = clean.select(F.xxhash64("text").alias("print"), all_ratios("text").alias("found")).where(F.size("found") > 0)
    found = [r.found for r in measured.orderBy("print").limit(SAMPLE_ROWS).collect()]

    def limits(edges: tuple[int, ...], pairs: list) -> tuple[tuple[float, ...], tuple[float, ...]]:
        band = np.searchsorted(edges, [x.size for x in pairs], side="right") - 1
        values, low, high = np.array([x.ratio for x in pairs]), [], []
        for i in range(len(edges)):
            inside = values[band == i]
            if not len(inside):
                raise ValueError(f"no clean text in the band from {edges[i]} bytes")
            few = 1 / len(inside)
            low.append(round(float(np.quantile(inside, tail) * (1 - below - few)), 2))
            high.append(round(float(np.quantile(inside, 1 - tail) * (1 + above + few)), 2))
        return tuple(low), tuple(high)

    low, high = limits(bands.edges, [x[0] for x in found])
    chunk_low, chunk_high = limits(bands.chunk_edges, [y for x in found for y in x[1:]])
    return replace(bands, low=low, high=high, chunk_low=chunk_low, chunk_high=chunk_high)
