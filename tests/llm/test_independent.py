"""Results recomputed in plain Python, without the code under test."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import pandas as pd
import xxhash

from gridloom.llm import imatch, langid, packing, shingles


def test_ridge_scores_are_those_of_the_method():
    rng = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "äöüabcde"}
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 6)))
    rows = [(" ".join(word(a) for _ in range(12)), lang) for lang, a in alphabets.items() for _ in range(20)]
    sample = pd.DataFrame(rows, columns=["text", "lang"])
    model = langid.fit(sample, landmarks=5, ridge=0.3)

    def spectrum(text):
        raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode()]
        return {tuple(raw[i : i + n]) for n in (1, 2, 3) for i in range(len(raw) - n + 1)}

    marks = [t for lang in sorted(alphabets) for t, x in rows if x == lang][0:5] + [t for t, x in rows if x == "bb"][:5] + [t for t, x in rows if x == "cc"][:5]
    sets = [spectrum(t) for t in marks]
    known = set().union(*sets)
    # n-grams of no landmark have no weight, neither in the kernel nor in its norm
    kernel = lambda a, b: len(a & b) / max(1, len(a & known)) ** 0.5 / max(1, len(b & known)) ** 0.5
    k_mm = np.array([[kernel(a, b) for b in sets] for a in sets])
    k_nm = np.array([[kernel(spectrum(t), b) for b in sets] for t, _ in rows])
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    x = k_nm @ root
    y = np.array([[1.0 if lang == c else -1.0 for c in sorted(alphabets)] for _, lang in rows])
    weights = root @ np.linalg.solve(x.T @ x + 0.3 * np.eye(x.shape[1]), x.T @ y)
    assert np.abs(model.scores([t for t, _ in rows]) - k_nm @ weights).max() < 1e-3
    names, scores = model.predict([rows[0][0], "", None, "12"])
    assert names == [sorted(alphabets)[int((k_nm[0] @ weights).argmax())], "und", "und", "und"] and 0 <= scores[0] <= 1


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def fold(numbers, seed=42):
    """The engine's hash of several 8- or 4-byte numbers, each seeded by the one before."""
    for n, size in numbers:
        seed = xxhash.xxh64_intdigest(n.to_bytes(size, "little", signed=True), seed)
    return seed


def marks_of(text, lexicon):
    terms = {t for t in re.split(r"[\W_]+", text.lower()) if t}
    h = {signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in terms}
    band = h & lexicon
    rest = sorted(h - lexicon, key=lambda x: (signed(fold([(x, 8), (11, 4)])), x))
    chosen = band | set(rest[: max(0, imatch.FEWEST - len(band))])
    cells = {}
    for x in chosen:
        draw = fold([(x, 8), (7, 4)])
        zeros = (draw & -draw).bit_length() - 1 if draw else 64
        for level in range(min(zeros // 2 + 1, imatch.LEVELS)):
            cells.setdefault(level * imatch.SUBSETS + (draw >> 40) % imatch.SUBSETS, []).append(x)
    return [f"{fold([(x, 8) for x in sorted(cells[i])]):016x}"[:4] if i in cells else "----" for i in range(imatch.LEVELS * imatch.SUBSETS)]


def likeness(a, b):
    best = None
    for level in range(imatch.LEVELS):
        both = list(zip(a, b, strict=True))[level * imatch.SUBSETS : (level + 1) * imatch.SUBSETS]
        seen = [p for p in both if p != ("----", "----")]
        if len(seen) >= (imatch.LEAST if level else 1):
            share = sum(x == y for x, y in seen) / len(seen)
            best = share if best is None else max(best, share)
    return 1.0 if best is None else best


def test_imatch_equals_plain_python(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([30, 400])]) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(60)] + ["", "Ünïcode straße", "..."]
    rows = list(enumerate(texts))
    df = Counter(t for x in texts for t in {t for t in re.split(r"[\W_]+", x.lower()) if t})
    n = len(texts)
    lexicon = {signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t, c in df.items() if max(1.0, imatch.RARE * n) <= c <= max(1.0, imatch.COMMON * n)}
    found = {r.doc_id: r for r in imatch.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        after = texts[doc - 1]  # descending ids; after the smallest comes the largest
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own, other, following = (marks_of(x, lexicon) for x in (text, edited, after))
        r = found[doc]
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(own), "".join(other))
        assert abs(r.near_edited - likeness(own, other)) < 1e-9 and abs(r.near_next - likeness(own, following)) < 1e-9


def test_imatch_very_long_text(spark):
    text = " ".join(f"term{i}" for i in range(120_000))
    rows = spark.createDataFrame([(1, text), (2, text + " more"), (3, "x")], "doc_id long, text string")
    r = {x.doc_id: x for x in imatch.edited_likeness(rows).collect()}
    assert r[2].near_next > 0.5 and r[1].n_chars == len(text)


def held(planned, capacity=1024):
    made = Counter()
    for config, n in planned:
        assert n > 0 and sum(k * v for k, v in config.items()) <= capacity
        for k, v in config.items():
            made[k] += v * n
    return made


def test_priced_configurations_pack():
    """Triplets that fill sequences exactly: at most 2 percent above the optimum, which best-fit misses by far more."""
    size = lambda p: sum(n for _, n in p)
    for seed in range(3):
        rng, triplets = random.Random(seed), Counter()
        while sum(triplets.values()) < 1500:
            a, b = rng.randint(257, 400), rng.randint(257, 400)
            if 257 <= 1024 - a - b <= 400:
                triplets.update((a, b, 1024 - a - b))
        priced, bound = packing.priced_plan(triplets, 1024)
        assert held(priced) == triplets and bound == pytest.approx(500)
        assert size(packing.plan(triplets)) == size(priced) <= 510 < size(packing.fill(triplets, 1024)) - 15


def test_priced_configurations_of_mixed_lengths():
    """Every sequence comes from the priced program; those of several pieces are told apart from single full ones."""
    rng = random.Random(1)
    mixed = Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000))
    priced, bound = packing.priced_plan(mixed, 1024)
    size = lambda p: sum(n for _, n in p)
    several = sum(n for config, n in priced if sum(config.values()) > 1)
    print("sequences", size(priced), "of several pieces", several, "bound", bound, "best-fit", size(packing.fill(mixed, 1024)))
    assert held(priced) == mixed and bound <= size(priced) <= 1.002 * bound + 1 and several == size(priced) - mixed[1024]
    assert size(packing.plan(mixed)) <= size(packing.fill(mixed, 1024))
    # counts a thousand times as large take no more rounds than there are lengths, and waste no more
    large = Counter({k: 1000 * v for k, v in mixed.items()})
    priced, bound = packing.priced_plan(large, 1024)
    assert held(priced) == large and size(priced) <= 1.002 * bound and len(priced) < 3000


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        counts, values = rng.integers(0, 4, 4), rng.random(4)
        config, worth = packing.best_configuration(values, lengths, counts, 20)
        best = max(float(np.dot(c, values)) for c in np.ndindex(*(counts + 1)) if np.dot(c, lengths) <= 20)
        assert abs(worth - best) < 1e-9 and abs(sum(values[list(lengths).index(k)] * v for k, v in config.items()) - best) < 1e-9


def test_fingerprints_of_sets_are_simhashes(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y"), (3, "")], "doc_id long, text string")
    marks = {r.id: r.marks for r in shingles.shingle_sets(docs, "doc_id", "text").collect()}
    for r in shingles.set_rows(docs, "doc_id", "text").collect():
        votes = [sum(m >> i & 1 for m in marks[r.id]) for i in range(64)]
        assert r.fp & (1 << 64) - 1 == sum(1 << i for i in range(64) if 2 * votes[i] > len(marks[r.id]))
        assert (r.n, r["keys"]) == (len(marks[r.id]), sorted(marks[r.id])[: shingles.KEYS])
