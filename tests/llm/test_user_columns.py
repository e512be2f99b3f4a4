"""Columns of the user with the names of working columns come back as they were."""

import pytest
from pyspark.sql import functions as F

from emberlog.llm import mixing, ngram_join, quality, suffix_dedup

NAMES = (
    "row row_id row_hash spans span shorter _id _hash _own _number _copy _cut _taken _text _quality kept class tile role label one map"
).split()


@pytest.fixture(scope="module")
def marked(documents):
    named = documents.where("doc_id is not null").dropDuplicates(["doc_id"]).drop("class")
    return named.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in NAMES]).cache()


@pytest.mark.parametrize(
    "stage", [quality.accepted, ngram_join.one_of_each, suffix_dedup.deduplicated, mixing.mixed_documents]
)
def test_user_columns_stay(marked, stage):
    got = stage(marked)
    assert got.columns == marked.columns
    rows = got.collect()
    assert rows
    for row in rows:
        assert [row[n] for n in NAMES] == [f"{n} {row.doc_id}" for n in NAMES]
