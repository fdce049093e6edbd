"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return [value(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([value(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = db.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(([value(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
