"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target number of words. Its documents are shuffled (by the MD5 of their id) and
read up to ``max_epochs`` times; the virtual finish time of a reading is the number of words the
source has given by then, divided by its target. All readings are merged by finish time, in range
buckets, which numbers the stream. It is cut at virtual time 1, per source: readings that finish by
then are whole, and the one in service is cut, so a source gives its target to within one word.

Defined results: a null text has no words, is never in service and takes 0. The null source is a
source of its own and comes last. Rows with the same id and text are ordered by nothing: they are
alike, so it does not matter which one is read first. Rows with a null id share one place in the
shuffle and are ordered by text. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import bucket_count, packed_rows, running_sum, text_or_empty, unpacked
from emberlog.session import stage

MAX_EPOCHS = 3
WORD_SQL = "[^\\\\x20\\\\x09-\\\\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words of a text."""
    return F.expr(f"cast(regexp_count(coalesce(cast(`{text}` as string), ''), '{WORD_SQL}') as bigint)")


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight, none above max_epochs times its size.

    Sources fill up in the order of limit / weight, so the level at which the rest is shared is found
    by running sums over the sources; this table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    ).withColumn("level", F.when(F.col("cap") * F.col("open") >= F.col("weight") * F.col("left"), F.col("left") / F.col("open")))
    return level.select(
        "source",
        "source_size",
        F.least("cap", F.col("weight") * F.max("level").over(everything)).alias("target"),
    )


def _shuffle_bucket(buckets: int) -> Column:
    """The leading bits of the shuffle key; rises with it."""
    bits = buckets.bit_length() - 1
    return F.shiftright(F.conv(F.substring("_shuffle", 1, 7), 16, 10).cast("long"), 28 - bits)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = MAX_EPOCHS,
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per reading: ``doc_id, row_hash, size, source, source_size, target, epoch, taken, finish, position``.

    ``taken`` is the number of words read and ``position`` the number of words the stream has given
    before. Every document has a row for epoch 0, also when it takes nothing.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source).alias("source"),
        F.xxhash64(text_or_empty(text)).alias("row_hash"),
        word_count(text).alias("size"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("_shuffle"),
    )
    rows = stage(rows, "mix-rows")  # narrow, and read several times below
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    count = rows.count()
    rows = rows.withColumn("_bucket", _shuffle_bucket(bucket_count(count)))
    order = [F.col("_shuffle"), F.col("doc_id"), F.col("row_hash")]
    queued = running_sum(rows, ["source"], "_bucket", order, F.col("size"), "_before")
    known = goals.select(F.col("source").alias("_source"), "source_size", "target")
    queued = _join_sources(queued, known)
    # At most max_epochs readings: the target is at most so many times the source.
    readings = F.greatest(F.lit(1), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("int")
    read = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), readings - 1)))
    start = F.col("epoch") * F.col("source_size") + F.col("_before")
    read = read.withColumn("_begun", start).where("epoch = 0 or _begun < target")
    # The stream ends at virtual time 1, when the budget (all targets) is used up.
    taken = F.least(F.col("size"), F.greatest(F.lit(0), F.floor("target") - F.col("_begun"))).cast("long")
    read = read.withColumn("taken", taken).withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("_begun") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    )
    slots = bucket_count(count)  # range buckets of the merged stream for each unit of virtual time
    read = read.withColumn("_slot", F.least(F.floor(F.least("finish", F.lit(2.0)) * slots), F.lit(2 * slots)).cast("long"))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("_begun"), *order]
    placed = running_sum(stage(read, "mix-readings"), [], "_slot", order, F.col("taken"), "position")
    return placed.select(
        "doc_id", "row_hash", "size", "source", "source_size", "target", "epoch", "taken", "finish", "position"
    )


def _join_sources(rows: DataFrame, known: DataFrame, copies: int = 16) -> DataFrame:
    """Adds the columns of a source; a hot source is spread over ``copies`` of its row."""
    salted = rows.withColumn("_salt", F.pmod(F.hash("_shuffle"), F.lit(copies)))
    spread = known.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_copy"))
    return salted.join(spread, same).drop("_salt", "_copy", "_source")


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its first ``words`` words, white space kept."""
    pieces = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents as often as they are read, the last reading cut to the words it takes."""
    readings = mix(docs.select("doc_id", "source", "text"), weights, max_epochs).where("taken > 0")
    # Repeated rows have one reading each; one number per reading keeps them from multiplying.
    copies = Window.partitionBy("doc_id", "row_hash", "epoch").orderBy("position")
    readings = readings.withColumn("_copy", F.row_number().over(copies)).select(
        F.col("doc_id").alias("_id"),
        F.col("row_hash").alias("_hash"),
        "_copy",
        (F.col("taken") < F.col("size")).alias("_cut"),
        F.col("taken").alias("_taken"),
    )
    keyed = packed_rows(docs).withColumn("_own", F.xxhash64(text_or_empty()))
    mine = Window.partitionBy("doc_id", "_own").orderBy(F.lit(0))
    keyed = keyed.withColumn("_number", F.row_number().over(mine))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")) & (F.col("_number") == F.col("_copy"))
    )
    cut = F.when(F.col("_cut"), first_words(text_or_empty("row.text"), F.col("_taken"))).otherwise(F.col("row.text"))
    joined = keyed.join(readings, same).withColumn("_text", cut)
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_cut"), F.length("_text")).otherwise(F.col("row.n_chars")).cast(kind)
    return joined.select(*unpacked(docs.columns, new))


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes.

    Repeated rows are told apart by their place in the stream.
    """
    readings = mix(docs, weights, max_epochs)
    copies = Window.partitionBy("doc_id", "row_hash", "epoch").orderBy("position")
    return (
        readings.withColumn("_copy", F.row_number().over(copies))
        .groupBy("doc_id", "row_hash", "_copy", "source")
        .agg(
            F.first("size").alias("size"),
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.sum("taken").alias("taken"),
        )
        .select("doc_id", "size", "source_size", "target", "taken")
    )
