"""A third of all rows identical: no step may gather them under one key."""

import random

from emberlog.llm import anchors, automaton_dedup, suffix_dedup
from pyspark.sql import functions as F


def test_repeated_rows_send_their_segments_once(spark):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    text, tail = prose(300), prose(60)
    rows = [(None, text)] * 300 + [(1, text[:1_000] + tail), (2, tail + prose(80)), (3, prose(200)), (4, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    keyed = anchors.with_row_key(docs).select("row_id", "row_hash", "text")
    found = anchors.find_segments(keyed, suffix_dedup._byte_units, 200, 32)
    prints = found.where("times > 0").groupBy("anchor", "print").agg(
        F.sum("times").alias("n"), F.lit(2).alias("members"), F.min(F.struct("row_id", "row_hash", "first", "windows")).alias("one")
    ).select("anchor", "print", "n", "members", "one.*")
    contents = anchors._contents(keyed, prints, 200, suffix_dedup._byte_cut)
    # One row for each different segment, not one for each row that has it.
    assert contents.count() <= prints.count() + 20
    report = {r.doc_id: r for r in suffix_dedup.report(docs).where("doc_id is null or doc_id > 0").collect()}
    assert report[None].n_removed == len(text) and report[4].n_removed == len(text) and report[3].n_removed == 0
    assert report[1].n_spans == 1 and report[1].n_removed >= 1_000 and report[2].n_removed in range(340, 362)
    words = {r.doc_id: r for r in automaton_dedup.report(docs).collect()}
    assert words[None].n_removed == 300 and words[4].n_removed == 300 and words[3].n_removed == 0
