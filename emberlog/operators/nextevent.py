"""Next-event model: counts of what followed each context, longest known context first.

``fit`` reduces training windows to distinct ones, then adds up the counts for every
context suffix of length 0..h. ``score`` looks up, for each distinct context, the longest
suffix seen in training.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.evaluate import symbols_ahead
from emberlog.operators.seqwin import join_distinct
from emberlog.session import small_rows, stage

# Fixed value: probabilities are clipped here before the logarithm.
MIN_PROBABILITY = 1e-7


def suffix_counts(train: DataFrame, h: int) -> DataFrame:
    """``k, suffix, next, cnt`` from windows (``context, next``, optional ``weight``)."""
    weight = F.col("weight") if "weight" in train.columns else F.lit(1)
    distinct = train.groupBy("context", "next").agg(F.sum(weight).alias("weight"))
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(h)),
        lambda k: F.struct(k.alias("k"), F.slice("context", F.lit(h + 1) - k, k).alias("suffix")),
    )
    return (
        distinct.select("next", "weight", F.explode(cut).alias("s"))
        .groupBy(F.col("s.k").alias("k"), F.col("s.suffix").alias("suffix"), "next")
        .agg(F.sum("weight").alias("cnt"))
    )


@dataclass
class NextEventModel:
    """``table``: ``k, suffix, total, dist`` with ``dist`` a map from next event to its count."""

    h: int
    table: DataFrame

    @classmethod
    def fit(cls, train: DataFrame, h: int) -> NextEventModel:
        # A context has at most one entry per vocabulary symbol, so the map stays small.
        dist = F.map_from_entries(F.collect_list(F.struct("next", "cnt")))
        table = suffix_counts(train, h).groupBy("k", "suffix").agg(F.sum("cnt").alias("total"), dist.alias("dist"))
        return cls(h, table)

    def write(self, path: str) -> NextEventModel:
        self.table.write.mode("overwrite").parquet(path)
        return self.load(self.table.sparkSession, path, self.h)

    def staged(self) -> NextEventModel:
        """The same model, read from a written table."""
        return NextEventModel(self.h, stage(self.table, "next-event"))

    @classmethod
    def load(cls, spark, path: str, h: int) -> NextEventModel:
        return cls(h, spark.read.parquet(path))

    def lookup(self, asked: DataFrame) -> DataFrame:
        """``context, k, total, dist, nexts`` for rows ``context`` (distinct), ``nexts``."""
        h = self.h
        cut = F.transform(
            F.sequence(F.lit(1), F.lit(h)),
            lambda k: F.struct(k.alias("k"), F.slice("context", F.lit(h + 1) - k, k).alias("suffix")),
        )
        # Which suffix is the longest known one is found with keys only; its counts are fetched once.
        # The table is shuffled, not broadcast: its files pack to a fiftieth of its rows in memory.
        rows = asked.select("context", F.explode(cut).alias("s")).select("context", "s.k", "s.suffix")
        keys = self.table.where("k > 0").select("k", "suffix")
        longest = rows.join(keys.hint("merge"), ["k", "suffix"]).groupBy("context").agg(F.max("k").alias("k"))
        suffix = F.slice("context", F.lit(h + 1) - F.col("k"), F.col("k"))
        wanted = asked.join(longest.hint("merge"), "context", "left").withColumn("suffix", suffix)
        stored = self.table.where("k > 0").select("k", "suffix", F.struct("k", "total", "dist").alias("m"))
        found = wanted.join(stored.hint("merge"), ["k", "suffix"], "left").select("context", "nexts", "m", F.lit(0).alias("_one"))
        # The empty suffix is one row (at most one entry per symbol), so it is safe to broadcast.
        base = self.table.where("k = 0").select(F.struct("k", "total", "dist").alias("m0"), F.lit(0).alias("_one"))
        return (
            found.join(F.broadcast(base), "_one", "left")
            .select("context", "nexts", F.coalesce("m", "m0").alias("m"))
            .select("context", "nexts", "m.*")
        )

    def judge(self, wins: DataFrame, value, out: str) -> DataFrame:
        """Windows plus ``out`` = ``value(count of next, total, counts of all)``.

        Each distinct context is looked up once; its few next events are judged there.
        """
        asked = wins.groupBy("context").agg(F.collect_set("next").alias("nexts"))
        values = F.transform(
            "nexts",
            lambda e: value(F.coalesce(F.try_element_at("dist", e), F.lit(0)), F.col("total"), F.map_values("dist")),
        )
        judged = self.lookup(asked).select("context", F.map_from_arrays("nexts", values).alias("_judged"))
        return join_distinct(wins, judged, "context").withColumn(out, F.col("_judged")[F.col("next")]).drop("_judged")

    def ahead(self, wins: DataFrame) -> DataFrame:
        """Windows plus ``ahead``, how many symbols are strictly more frequent than the next event."""
        return self.judge(wins, symbols_ahead, "ahead")

    def hits(self, wins: DataFrame, g: int) -> DataFrame:
        """Windows plus ``hit`` by the top-g rule."""
        return self.ahead(wins).withColumn("hit", F.col("ahead") < g)

    def log_likelihood(self, wins: DataFrame) -> DataFrame:
        """Windows plus ``ll``, the clipped log-probability of ``next`` given ``context``."""
        return self.judge(wins, lambda n, total, _: F.log(F.greatest(n / total, F.lit(MIN_PROBABILITY))), "ll")


def session_min_likelihood(scored: DataFrame) -> DataFrame:
    return scored.groupBy("session_id").agg(F.min("ll").alias("score"))


def vocabulary_list(vocab: DataFrame, limit: int = 100_000) -> list[str]:
    """The symbols in index order, on the driver; raises if the vocabulary is not small."""
    return [r["event"] for r in sorted(small_rows(vocab, limit), key=lambda r: r["idx"])]
