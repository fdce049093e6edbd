"""Queries with SQL give the rows that DuckDB gives."""

import os

import duckdb
import pytest

from gridloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[k] for k in columns) for r in df.collect()) == sorted(tuple(r[names.index(k)] for k in columns) for r in found.fetchall())


def test_all_operators_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
