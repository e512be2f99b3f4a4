"""Registered plans against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
CHECKED = (
    "next_event_report", "parse_args", "parse_stop_short", "parse_line_id", "sessions_build", "sessions_label",
    "split_balanced", "split_summary", "seq_index", "win_train_dedup", "seq_train_dedup", "next_dist",
    "select_by_f1", "boundary_eval", "outcome_render", "feat_tfidf", "feat_transform", "tw_members", "tw_bounds",
    "src_raw_lines", "src_rich_instances", "snk_outcomes", "gram", "clu_pairs", "clu_predict", "ngram_features",
    "score_udf", "stream_tw_counts", "src_instances", "outcome_templates", "clu_directions", "clu_online_directions",
    "report_fixed", "stream_directions", "tw_grid", "snk_structured_openstack", "win_loglik", "topg_hit",
)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_plan_equals_sql(spark, database, name):
    df = contract.queries()[name](spark, SF)
    got = df.collect()
    oracle = database.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(oracle.columns)
    assert rows_of(df.columns, got) == rows_of(oracle.columns, oracle.fetchall())


def test_every_oracle_has_a_plan():
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).count() == 1
