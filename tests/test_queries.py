"""Every query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagefold.plans import catalog, requests

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = catalog.QUERIES | requests.QUERIES, catalog.ORACLE_SQL | requests.ORACLE_SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    tidy = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(tidy(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
