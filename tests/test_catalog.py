"""Every query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tracemill import catalog

DATA = "/root/testdata/sf0.001"


def rows(values):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(f"{v:.9g}") if isinstance(v, float) else v

    return sorted((tuple(map(plain, r)) for r in values), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = [tuple(r[c] for c in columns) for r in found.collect()]
    if name in catalog.SQL:
        relation = duck.sql(catalog.SQL[name])
        names = list(relation.columns)
        assert sorted(names) == columns
        assert rows(mine) == rows(tuple(r[names.index(c)] for c in columns) for r in relation.fetchall())
