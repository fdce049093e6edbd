"""All queries of the library by name, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers ``f(spark, sf_dir)`` under its name, with the SQL of its result if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
