"""The Merkle manifest against a tree built in one piece."""

import hashlib
import random
import zlib

import pytest

from gridloom.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def record(row, lower=False):
    doc, source, lang, n, text = row
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if lower and text is not None else text
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(nodes, fanout):
    """Root, and for each leaf its levels as (run, place)."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, way in enumerate(ways):
            run = level[at[i] // fanout * fanout : at[i] // fanout * fanout + fanout]
            way.append((run, at[i] % fanout))
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [a // fanout for a in at]
    return level[0], ways


def brute(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, record(r)))
        trees[s] = (mine, *tree([record(r) for r in mine], fanout))
    root, tops = tree([trees[s][1] for s in names], fanout)
    out = []
    for s, top in zip(names, tops):
        mine, subroot, ways = trees[s]
        for row, way in zip(mine, ways):
            proof = "".join(d for run, place in way + top for k, d in enumerate(run) if k != place)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = record(row, tampered)
            for run, place in way + top:
                node = H(*run[:place], node, *run[place + 1 :])
            out.append((row[0], record(row), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def found(spark, rows, fanout, levels):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as leaf", "2 as root", "'x' as digest", "3 as idx")
    out = merkle.audited(merkle.document_records(docs), fanout, levels)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in out.collect()), key=repr)


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice([*sources, None, "hot", "hot", "hot"])
        text = rng.choice([None, "", f"Text Ää {i} " * rng.randint(1, 3), "lower only"])
        out.append((i * 7919 % 1009, source, rng.choice(["en", None]), rng.choice([None, i]), text))
    return out


@pytest.mark.parametrize(("fanout", "levels", "n"), [(2, 1, 70), (2, 2, 100), (3, 2, 200), (16, 3, 60)])
def test_manifest_equals_a_tree_in_one_piece(spark, fanout, levels, n):
    """Superblocks of a few leaves, so that trees take several rounds, with last runs of one."""
    rows = rows_of(n, n, ["a", "b", "Z", "ä", "lonely"])
    got = found(spark, rows, fanout, levels)
    assert got == brute(rows, fanout)
    assert {v for *_, v in got} == {True, False}


def test_ties_nulls_and_single_rows(spark):
    same = (5, "s", "en", 1, "Same")
    rows = [same, same, (None, "s", "en", 1, "no id"), (5, "s", "en", 1, "other"), (2**60 + 1, None, None, None, None), (7, "é", None, 3, "x" * 100_000)]
    assert found(spark, rows, 2, 2) == brute(rows, 2)
    assert found(spark, [same], 16, 3) == [(5, record(same), record(same), record(same), "", record(same), True)]
    assert found(spark, [], 16, 3) == []


def test_a_proof_holds_for_its_own_leaf_alone(spark):
    from pyspark.sql import functions as F

    rows = [(i, "s" if i % 3 else "t", "en", 1, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(merkle.document_records(docs), "source", "doc_id", fanout=2, levels=2)
    wrong = out.withColumn("folded", merkle.folded(F.sha2(F.col("leaf"), 256)))
    assert wrong.where("folded = root").count() == 0 and out.withColumn("folded", merkle.folded(F.col("leaf"))).where("folded = root").count() == 40
