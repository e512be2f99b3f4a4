"""Event-count features: counts, vocabulary, tf-idf, centring, sigmoid, out-of-vocabulary counts.

Counts stay in long form (``session_id, event, cnt``) so only events that occur are carried;
the wide form has one slot per vocabulary symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.sequences import dense_vector, sigmoid_nonzero
from emberlog.operators.lookup import looked_up
from emberlog.session import SMALL_ROWS, stage

OOV = "_OOV"


def event_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary_with_df(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """``event, idx, df``: events present in at least ``min_count`` sessions, sorted.

    One row per symbol, so numbering them in one task is safe.
    """
    place = (F.row_number().over(Window.orderBy("event")) - 1).cast("bigint")
    found = counts.groupBy("event").agg(F.count(F.lit(1)).alias("df"))
    return found.where(F.col("df") >= min_count).withColumn("idx", place)


def oov_counts(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``session_id, oov``: distinct events of each session outside the vocabulary (0 included)."""
    unknown = F.col("_known").isNull().cast("bigint")
    return _marked(counts, vocab).groupBy("session_id").agg(F.sum(unknown).alias("oov"))


def _marked(counts: DataFrame, vocab: DataFrame, *columns: str) -> DataFrame:
    """Counts with ``_known`` (null for an event outside the vocabulary) and columns of the vocabulary."""
    return looked_up(counts, vocab.select("event", *columns, F.lit(1).alias("_known")), "event")


@dataclass
class FeatureModel:
    """Fitted on training counts; ``table`` is ``event, idx, df, idf, mean`` (one row per column)."""

    table: DataFrame
    term_weighting: str | None = None
    normalization: str | None = None
    oov: bool = False

    @classmethod
    def fit(
        cls,
        counts: DataFrame,
        term_weighting: str | None = None,
        normalization: str | None = None,
        oov: bool = False,
        min_count: int = 1,
    ) -> FeatureModel:
        vocab = stage(vocabulary_with_df(counts, min_count if oov else 1), "vocabulary")
        long = _with_oov(counts, vocab, oov)
        seen = long.groupBy("event").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("total"))
        columns = vocab.select("event", "idx")
        if oov:
            last = columns.agg(F.count(F.lit(1)).alias("idx")).select(F.lit(OOV).alias("event"), "idx")
            columns = columns.union(last)
        n = float(counts.agg(F.count_distinct("session_id").alias("n")).first()["n"])
        df, total = F.coalesce("df", F.lit(0)), F.coalesce("total", F.lit(0))
        idf = F.log(F.lit(n) / (df + F.lit(1e-8))) if term_weighting == "tf-idf" else F.lit(1.0)
        table = columns.join(seen, "event", "left").select(
            "event", "idx", df.alias("df"), idf.alias("idf"), (total * idf / F.lit(n)).alias("mean")
        )
        return cls(stage(table, "features"), term_weighting, normalization, oov)

    def write(self, path: str) -> FeatureModel:
        self.table.write.mode("overwrite").parquet(path)
        return FeatureModel(
            self.table.sparkSession.read.parquet(path), self.term_weighting, self.normalization, self.oov
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> FeatureModel:
        return cls(spark.read.parquet(path), **options)

    def _weighted(self, cnt: Column, idf: Column) -> Column:
        x = cnt * idf
        return sigmoid_nonzero(x) if self.normalization == "sigmoid" else x

    def transform_sparse(self, counts: DataFrame) -> DataFrame:
        """``session_id, event, idx, x`` for non-zero counts; unknown events go to the OOV column."""
        long = _with_oov(counts, self.table.where(F.col("event") != OOV), self.oov)
        out = looked_up(long, self.table.select("event", "idx", "idf"), "event", "inner")
        return out.select("session_id", "event", "idx", self._weighted(F.col("cnt"), F.col("idf")).alias("x"))

    def transform(self, counts: DataFrame) -> DataFrame:
        """``session_id, features array<double>``, one slot per fitted column, in one shuffle by session.

        For more than ``SMALL_ROWS`` columns use ``transform_sparse``.
        """
        width = self.table.count()
        if width > SMALL_ROWS:
            raise ValueError(f"more than {SMALL_ROWS} columns")
        marked = _marked(counts, self.table.where(F.col("event") != OOV), "idx", "idf")
        entry = F.struct("idx", self._weighted(F.col("cnt"), F.col("idf")).alias("x"))
        unknown = F.col("_known").isNull()
        grouped = marked.groupBy("session_id").agg(
            F.sort_array(F.collect_list(F.when(~unknown, entry))).alias("_entries"),
            F.count_if(unknown).alias("_oov"),
        )
        if self.oov:
            # The column of unknown events is the last one.
            last = self.table.where(F.col("event") == OOV).first()
            x = self._weighted(F.col("_oov"), F.lit(float(last["idf"]))).alias("x")
            own = F.array(F.struct(F.lit(last["idx"]).cast("bigint").alias("idx"), x))
            grouped = grouped.withColumn("_entries", F.when(F.col("_oov") > 0, F.concat("_entries", own)).otherwise(F.col("_entries")))
        dense = grouped.select("session_id", dense_vector(F.col("_entries"), width).alias("features"))
        if self.normalization != "zero-mean":
            return dense
        # One row: the means in the order of the columns.
        means = self.table.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "mean"))), lambda m: m["mean"]).alias("_means"))
        both = dense.withColumn("_one", F.lit(1)).join(F.broadcast(means.withColumn("_one", F.lit(1))), "_one")
        return both.select("session_id", F.zip_with("features", "_means", lambda v, m: v - m).alias("features"))


def _with_oov(counts: DataFrame, vocab: DataFrame, oov: bool) -> DataFrame:
    """Counts of vocabulary events, plus one ``OOV`` row per session that has unknown ones."""
    marked = _marked(counts, vocab)
    known = marked.where(F.col("_known").isNotNull()).select("session_id", "event", "cnt")
    if not oov:
        return known
    extra = marked.where(F.col("_known").isNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("cnt"))
    return known.union(extra.select("session_id", F.lit(OOV).alias("event"), "cnt"))


def count_vectors(counts: DataFrame, vocab: list[str]) -> DataFrame:
    """``session_id, features array<double>`` of raw counts over a given vocabulary."""
    table = counts.sparkSession.createDataFrame([(e, i) for i, e in enumerate(vocab)], "event string, idx bigint")
    entry = F.when(F.col("_known").isNotNull(), F.struct("idx", F.col("cnt").cast("double").alias("x")))
    slots = _marked(counts, table, "idx").groupBy("session_id").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    return slots.select("session_id", dense_vector(F.col("_entries"), len(vocab)).alias("features"))


def distinct_vectors(vectors: DataFrame, *keep: str) -> DataFrame:
    """Distinct ``features`` (and ``keep``) with ``weight``: detectors read these instead of rows."""
    return vectors.groupBy("features", *keep).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def class_weights(heads: DataFrame, weights: str | dict[int, float] | None = "balanced") -> DataFrame:
    """Add ``class_weight``: 1, ``n / (2 n_c)``, or the value given per label."""
    if weights is None:
        return heads.withColumn("class_weight", F.lit(1.0))
    positive = F.col("label") > 0
    if isinstance(weights, dict):
        return heads.withColumn(
            "class_weight", F.when(positive, float(weights.get(1, 1.0))).otherwise(float(weights.get(0, 1.0)))
        )
    row_weight = F.col("weight") if "weight" in heads.columns else F.lit(1.0)
    marked = heads.select("*", positive.alias("_pos"))
    # Two rows: one per class.
    sizes = marked.groupBy("_pos").agg(F.sum(row_weight).alias("_c"))
    sizes = sizes.select("_pos", (F.sum("_c").over(Window.partitionBy()) / (2 * F.col("_c"))).alias("class_weight"))
    return marked.join(F.broadcast(sizes), "_pos").drop("_pos")
