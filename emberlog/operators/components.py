"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import stage

# Links that one task joins up; more of them go through rounds of joins.
ONE_TASK = 500_000


def joined_up(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least connected number of each of ``n`` nodes."""
    least = np.arange(n)
    while len(a):
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(least, high, low)
        while True:
            onward = least[least]
            if np.array_equal(onward, least):
                break
            least = onward
    return least


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    links = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *batches])
    names, at = np.unique(links[["a", "b"]].to_numpy(dtype=np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    yield pd.DataFrame({"id": names, "component": names[joined_up(len(names), at[:, 0], at[:, 1])]})


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``id, component`` (its least id) for every id in the written ``links`` (``a, b``)."""
    if links.limit(one_task + 1).count() <= one_task:
        return links.select("a", "b").coalesce(1).mapInPandas(_in_one_task, "id bigint, component bigint")
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    least = stage(
        links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "least"
    )
    while True:
        around = both.join(least.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
        lower = least.join(around.agg(F.min("component").alias("_low")), "id", "left").select(
            "id", F.least("component", "_low").alias("_to"), F.col("component").alias("_from")
        )
        # What the new least node itself has as least so far: halves the way of long chains.
        known = least.select(F.col("id").alias("_to"), F.col("component").alias("_further"))
        moved = stage(lower.join(known, "_to", "left").withColumn("_new", F.least("_to", "_further")), "least")
        least = moved.select("id", F.col("_new").alias("component"))
        if moved.where("_new <> _from").isEmpty():
            return least
