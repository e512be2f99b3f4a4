"""Registered corpus queries against their SQL on the smallest tables."""

import duckdb
import pytest

from emberlog.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    oracle = con.sql(queries.ORACLE[name])
    columns = sorted(oracle.columns)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    got = [tuple(r) for r in df.select(*columns).collect()]
    want = [tuple(r) for r in oracle.project(", ".join(columns)).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
