"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import os

import duckdb
import pytest

from voxelith.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "null" if value != value else repr(round(value, 4) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert rows == want


def test_other_queries_have_a_schema(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).columns
