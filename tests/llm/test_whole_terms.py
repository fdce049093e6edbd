"""I-Match fingerprints of texts that have no term in the band."""

from gridloom.llm import imatch


def test_texts_without_band_terms_differ(spark):
    base = [f"code{i}" for i in range(40)]
    texts = {
        1: " ".join(base), 2: " ".join(f"name{i}" for i in range(40)), 3: " ".join([*base[:38], "edit1", "edit2"]),
        4: " ".join(base[:20]), 5: " ".join(base[:21]), 6: "", 7: "...",
    }
    rows = spark.createDataFrame([(i, 0, t, "n") for i, t in texts.items()], "id long, kind int, text string, note string")
    none = spark.createDataFrame([], "h long")
    marks = {r.id: r.marks for r in imatch.fingerprints(rows, none).collect()}
    pairs = spark.createDataFrame([(a, b, marks[a], marks[b]) for a, b in ((1, 2), (1, 3), (4, 5), (6, 7), (1, 6))], "x int, y int, a array<string>, b array<string>")
    found = {(r.x, r.y): r.v for r in pairs.select("x", "y", imatch.likeness("a", "b").alias("v")).collect()}
    assert all(set(marks[i]) != {imatch.EMPTY} for i in range(1, 6)) and set(marks[6]) == set(marks[7]) == {imatch.EMPTY}
    assert found[1, 2] < 0.2 and found[1, 3] > 0.5 and found[4, 5] > 0.5
    assert found[6, 7] == 1 and found[1, 6] == 0
