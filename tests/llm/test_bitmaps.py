"""The filter audit against counting row by row."""

import itertools
import re

import numpy as np

from gridloom.llm import bitmaps


def brute(docs, labels):
    """Rows of (doc_id, text, lang); labels of (doc_id, quality, toxic)."""
    seen = []
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs):
            fails.add("E")
        seen.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in seen}:
        rows = [r for r in seen if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                fail = [r for r in rows if f in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), len(fail) - len(gone), sum(r[1] == {f} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                left = stay
        for key in out:
            if key[0] == part and isinstance(out[key][-1], str):
                out[key][-1] = total[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG + " #", "de"), (4, None, None), (5, "", ""), (6, "A B C", "en"), (None, LONG, "en"), (7, "a a a a a a", "de"),
    (8, LONG.upper(), "fr"), (9, "x" * 100_000 + " %", "fr"), (10, "a\x0bb\x1fc ÄÄ", "de"), (10, LONG, "de"), (11, LONG, None),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, None, 1), (6, 0, 1), (6, 1, None), (8, 1, 0), (None, 1, 1), (99, 1, 1)]


def found(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as part", "2 as good", "'x' as h", "3 as E")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = bitmaps.interactions(bitmaps.audited_rows(d, lab)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_counts_equal_brute_force(spark):
    assert found(spark, DOCS, LABELS) == brute(DOCS, LABELS)
    assert found(spark, DOCS[:2], []) == brute(DOCS[:2], [])


def test_empty_tables(spark):
    assert found(spark, [], LABELS) == {}


def test_bits_of_parts_do_not_mix():
    """Parts of every size from 1 to 20 rows, so that last bytes are filled in every way."""
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 21)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    flags, labels = rng.random((3, sizes.sum())) < 0.4, rng.random((2, sizes.sum())) < 0.3
    counts = bitmaps.prefix_counts(flags, labels, starts)
    for p, (a, n) in enumerate(zip(starts, sizes)):
        f, good = flags[:, a : a + n], labels[0, a : a + n]
        for s in range(8):
            alive = ~np.any(f[[i for i in range(3) if s >> i & 1]], axis=0) if s else np.ones(n, bool)
            for k in range(3):
                if not s >> k & 1:
                    assert counts[p, s, k, :3].tolist() == [alive.sum(), (alive & f[k]).sum(), (alive & f[k] & good).sum()]


def test_many_parts_and_batches(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "PARTS", 3)
    docs = [(i, "a " * (i % 7), f"l{i % 11}") for i in range(300)]
    assert found(spark, docs, [(i, 1, i % 2) for i in range(0, 300, 3)]) == brute(docs, [(i, 1, i % 2) for i in range(0, 300, 3)])
