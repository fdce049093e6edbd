"""What the fourth round of findings was about."""

import random

import duckdb

from gridloom.llm import lines
from gridloom.plans import design as plans
from gridloom.registry import ORACLE_SQL


def test_sizes_on_a_half_are_rounded_as_in_the_sql(spark, tmp_path):
    """prices whose 5000th part lies between two whole sizes, below an even and below an odd one."""
    rows = [(n, n, "FOP"[n % 3], 2500.0 * (2 * n + 1), "1-URGENT") for n in range(1, 60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    customers = [(n, f"segment {n % 5}", 0.0) for n in range(20)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {tuple(r) for r in plans.allocation_outcomes(spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        for name in ("orders", "customer"):
            c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        assert got == set(c.execute(ORACLE_SQL["allocation_outcomes"]).fetchall())
    assert (12, "OK", 12) in got and (13, "OK", 14) in got


def test_one_common_passage_makes_no_candidates(spark):
    """long lines that share a passage alone meet under no key; changes all over a line leave it under keys of its original."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    passage, base = words(9), words(60)
    texts = [[*words(20 + i % 7), *passage, *words(30 - i % 7)] for i in range(40)]
    texts += [base, [w if i % 7 else "changed" for i, w in enumerate(base)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    table = lines.distinct_lines(lines.line_rows(docs, "doc_id", "text")).select("*", "at.id").cache()
    ids = {r.node: r.id for r in table.collect()}
    under = {}
    for r in lines.keyed_lines(table).collect():
        under.setdefault(r.key, set()).add(ids[r.node])
    assert {frozenset(nodes) for nodes in under.values() if len(nodes) > 1} == {frozenset({40, 41})}
    assert {r.doc_id for r in lines.deduplicate(docs).where("n_kept = 0").collect()} == {41}
