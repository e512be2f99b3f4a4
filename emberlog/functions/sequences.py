"""Array expressions on event sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the padding symbol.
PAD = "_PAD"


def pad_left(events: Column, lower_bound: int) -> Column:
    missing = F.greatest(F.lit(lower_bound) - F.size(events), F.lit(0))
    return F.concat(F.array_repeat(F.lit(PAD), missing), events)


def pad_right(events: Column, length: int) -> Column:
    missing = F.greatest(F.lit(length) - F.size(events), F.lit(0))
    return F.slice(F.concat(events, F.array_repeat(F.lit(PAD), missing)), 1, length)


def dense_vector(entries: Column, size: int) -> Column:
    """Doubles at ``size`` places from an array of (``idx``, ``x``) that rises in ``idx``; 0 elsewhere."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))

    def part(e: Column, i: Column) -> Column:
        before = F.coalesce(F.get(entries, i - 1)["idx"], F.lit(-1))
        return F.concat(zeros(e["idx"] - before - 1), F.array(e["x"]))

    last = F.coalesce(F.try_element_at(entries, F.lit(-1))["idx"], F.lit(-1))
    return F.concat(F.flatten(F.transform(entries, part)), zeros(F.lit(size - 1) - last))


def one_hot_label(label: Column) -> Column:
    return F.array(F.lit(1) - label.cast("int"), label.cast("int"))


def sigmoid_nonzero(x: Column) -> Column:
    return F.when(x != 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.lit(0.0))


def cosine_distance(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """1 - cosine, with tiny values taken as 0 and a zero vector at distance 1."""
    raw = F.lit(1.0) - dot / (norm_a * norm_b + F.lit(1e-8))
    return F.when(raw < 1e-8, F.lit(0.0)).otherwise(raw)
