"""Toxicity: folding, exceptions, what is learned from whom, and held-out accuracy."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries, toxicity


def test_folding():
    fold = lambda t: toxicity.fold(t)[0]
    assert fold("You 1D10T, l0ser and $cum!") == ["you", "idiot", "loser", "and", "scum"]
    assert fold("іdіоt ｉｄｉｏｔ") == ["idiot", "idiot"]  # Cyrillic, full width
    assert fold("in 1999 at 10:30 for 5$") == ["in", "at", "for"]  # numbers stay numbers
    assert toxicity.fold("c1own ídiot") == (["ciown", "ídiot"], ["clown", "idiot"])
    assert toxicity.fold("") == ([], [])


def corpus(seed=1, n=600):
    """Toxic texts hold insults; 'trash' is one but for the trash can of clean texts; ids from 0."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        mine = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        for _ in range(len(mine) // 20 if toxic else 0):
            mine.insert(rng.randrange(len(mine)), rng.choice(["idiot", "loser", "trash", "vequ" + rng.choice(words)]))
        if not toxic and i % 12 == 1:
            at = rng.randrange(len(mine))
            mine[at:at] = ["trash", "can"]
        rows.append((i, " ".join(mine)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    sample = toxicity.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    return toxicity.fit(sample, exceptions=["idiot proof"])


def test_lexicon_and_exceptions(model):
    weights = {t: w[0] for t, w in model.terms.items()}
    assert weights[" idiot "] > 3 and weights[" loser "] > 3 and any(t.startswith(" vequ") for t in weights)
    assert " trash can " in model.exceptions and weights[" trash "] > 3
    clean = "one two three four five six seven eight nine ten " * 3
    low = model.score(clean)
    assert model.score(clean + "trash can") == model.score(clean + "idiot proof ") == pytest.approx(low, abs=0.05)
    for bad in ("idiot loser", "1d10t l0ser", "іdіot 1oser", "vequabc vequhga", "trash trash"):
        assert model.score(clean + bad) > 0.5 > low, bad
    # the longer the text, the less a single hit says
    assert model.score("loser " + clean * 50) < model.score("loser " + clean)


def test_scores_of_odd_rows(spark, model):
    long = "word " * 300_000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!!"), (4, long), (4, long), (5, long + "idiot " * 9000)], "doc_id long, Text string").selectExpr("*", "'x' as SCORE", "7 as toxic")
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "Text", "toxic", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 6 and [r.predicted for r in rows] == [0, 0, 0, 0, 0, 1] and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.fit(toxicity.labelled_sample(docs, none))).collect()] == [0, 0]
    clean = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score(docs, toxicity.fit(toxicity.labelled_sample(docs, clean))).collect())


def test_held_out_labels_are_not_read_and_predicted_well(spark, tmp_path):
    rows, labels = corpus(2)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scores = []
    for name, flip in (("a", False), ("b", True)):
        spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, 1 - x if flip and held(i) else x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = queries.op12_toxicity(spark, f"{tmp_path}/{name}")
        assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
        scores.append({r.doc_id: (r.held_out, r.score, r.predicted) for r in out.collect()})
    assert scores[0] == scores[1] and all(h == held(i) for i, (h, _, _) in scores[0].items())
    truth = dict(labels)
    right = [p == truth[i] for i, (h, _, p) in scores[0].items() if h]
    assert len(right) > 80 and sum(right) >= 0.95 * len(right)


def test_near_copies_count_once(spark):
    """A rare word of a text that was copied a hundred times with small edits is no evidence."""
    rows, labels = corpus(3)
    base = ("harmless zyxword " + " ".join(f"t{i}" for i in range(60))).split()
    for k in range(100):
        mine = base[:]
        mine[5 + k % 50] = f"edit{k}"
        rows.append((10_000 + k, " ".join(mine)))
        labels.append((10_000 + k, 1))
    sample = toxicity.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sample.where(F.col("text").contains("zyxword")).count() < 15
