"""The corpus queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tracemill.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.sql(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    relation = connection.sql(queries.SQL[name])
    columns = sorted(relation.columns)
    want = sorted((tuple(r[relation.columns.index(c)] for c in columns) for r in relation.fetchall()), key=str)
    found = queries.QUERIES[name](spark, DATA)
    assert sorted(found.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == want
