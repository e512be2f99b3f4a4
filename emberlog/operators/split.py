"""Train / validate / test assignment as a ``split`` column on the session heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.order import LINE_BUCKET, line_bucket, rank_in_order

# Fixed value: in the balanced split, test negatives start this far past the train negatives.
BALANCED_TEST_START = 1.33


def _share(ratio: float, count: Column) -> Column:
    return F.floor(F.lit(float(ratio)) * count.cast("double")).cast("bigint")


def _check(train_ratio: float, test_ratio: float | None) -> None:
    if train_ratio + (test_ratio or 0) > 1 + 1e-12:
        raise ValueError("train_ratio + test_ratio must not exceed 1")


def _assign(df: DataFrame, rank: str, train_end: Column, test_start: Column) -> DataFrame:
    place = F.col(rank)
    name = F.when(place < train_end, "train").when(place < test_start, "validate").otherwise("test")
    return df.withColumn("split", name)


def split_uniform(
    heads: DataFrame,
    train_ratio: float,
    test_ratio: float | None = None,
    balanced: bool = False,
    width: int = LINE_BUCKET,
) -> DataFrame:
    """Cut each class at the same shares, in order of first appearance.

    ``balanced`` trains on as many negatives as positives.
    """
    _check(train_ratio, test_ratio)
    positive = F.col("label") > 0
    ranked = rank_in_order(
        heads.select("*", positive.cast("int").alias("_pos")),
        line_bucket("first_line", width),
        ["first_line", "session_id"],
        ["_pos"],
        "class_rank",
        "_own",
    )
    own = F.col("_own")
    train_end = _share(train_ratio, own)
    if balanced:
        # The positives' train size rules both classes.
        n_pos = heads.agg(F.count_if(positive).alias("n")).scalar()
        train_end = _share(train_ratio, n_pos)
    test_start = train_end
    if test_ratio:
        test_start = own - _share(test_ratio, own)
        if balanced:
            past = F.floor(train_end.cast("double") * F.lit(BALANCED_TEST_START)).cast("bigint")
            test_start = F.when(positive, test_start).otherwise(past)
    return _assign(ranked, "class_rank", train_end, test_start).drop("_pos", "_own")


def split_sequential(
    heads: DataFrame, train_ratio: float, test_ratio: float | None = None, width: int = LINE_BUCKET
) -> DataFrame:
    """Cut all sessions at the given shares, in order of first appearance."""
    _check(train_ratio, test_ratio)
    ranked = rank_in_order(
        heads,
        line_bucket("first_line", width),
        ["first_line", "session_id"],
        out="seq_no",
        count_out="_total",
    )
    total = F.col("_total")
    train_end = _share(train_ratio, total)
    test_start = total - _share(test_ratio, total) if test_ratio else train_end
    return _assign(ranked, "seq_no", train_end, test_start).drop("_total")


def split_sessions(
    heads: DataFrame,
    train_ratio: float = 0.5,
    split_type: str = "sequential",
    test_ratio: float | None = None,
    balanced: bool = False,
    labelled: bool = True,
) -> DataFrame:
    """The loaders' rule: balanced implies uniform, and without labels only sequential is possible."""
    if not labelled or (split_type == "sequential" and not balanced):
        return split_sequential(heads, train_ratio, test_ratio)
    if split_type not in ("uniform", "sequential"):
        raise ValueError(f"unknown split type {split_type}")
    return split_uniform(heads, train_ratio, test_ratio, balanced)


def split_index(
    heads: DataFrame, train_ratio: float, test_ratio: float | None = None, balanced: bool = False
) -> DataFrame:
    """``row_idx, split``: the class-wise split as row numbers; the test part defaults to the rest."""
    rest = 1 - train_ratio if not test_ratio else test_ratio
    parts = split_uniform(heads, train_ratio, rest, balanced)
    return rank_in_order(
        parts, line_bucket("first_line"), ["first_line", "session_id"], out="row_idx"
    ).select("session_id", "row_idx", "split")


def shuffled(heads: DataFrame, seed: int = 42) -> DataFrame:
    """Add ``shuffle_no``: a repeatable random order, by hash of the session id."""
    keyed = heads.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("session_id"))))
    bucket = F.conv(F.substring("_key", 1, 4), 16, 10).cast("int")
    return rank_in_order(keyed, bucket, ["_key", "session_id"], out="shuffle_no").drop("_key")


def split_summary(parts: DataFrame) -> DataFrame:
    """Totals, anomalies and normals per split, with a ``total`` row."""
    anomaly = F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))
    return (
        parts.rollup("split")
        .agg(F.count(F.lit(1)).alias("total"), anomaly.alias("anomaly"))
        .select(
            F.coalesce("split", F.lit("total")).alias("split"),
            "total",
            "anomaly",
            (F.col("total") - F.col("anomaly")).alias("normal"),
        )
    )
