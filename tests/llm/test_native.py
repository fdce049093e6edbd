"""PII, I-Match, fuzzy lines and decontamination against plain Python."""

import hashlib
import re

import pytest

from gridloom.llm import decontam, imatch, lines, pii

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def word_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, bench, size=13):
    windows = {}
    for item, text in bench:
        w = word_list(text)
        for i in range(max(1, len(w) - size + 1)) if w else []:
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, items = word_list(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[k]
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def found_contamination(docs, bench):
    rows = decontam.contamination(docs, bench).collect()
    return [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in rows]


def test_contamination_equals_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(found_contamination(docs, bench)) == sorted(want)
    assert any(r[-1] for r in want)


def test_contamination_edges(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(30))
    bench = [(1, long), (2, long), (3, "Short One"), (4, None), (5, "..."), (6, "É accent")]
    docs = [(1, None), (2, ""), (3, "x short, ONE y"), (4, long.upper()), (4, long.upper()), (5, "é accent"), (6, "É ACCENT"), (None, f"pad {long}"), (7, " ".join(["a"] * 400) + " short one"), (8, f"{long} {long}")]
    d, b = docs_of(spark, docs).selectExpr("*", "'k' as word", "1 as id"), spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "0 as words")
    want = sorted(brute_contamination(docs, bench), key=str)
    assert sorted(found_contamination(d, b), key=str) == want
    monkeypatch.setattr(decontam, "PASS_WINDOWS", 5)
    assert sorted(found_contamination(d, b), key=str) == want
    assert found_contamination(d.limit(0), b) == []
    assert all(r[2] == 0 for r in found_contamination(d, b.limit(0)))
    left = decontam.clean(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {1, 2, 5, 7}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines_keep_one_of_each_group(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green tree"
    near = base.replace("lazy", "lasy").replace("seven", "sevan")
    other = "completely different words make up this line so that nothing here is shared with any line above or below it today"
    rows = [(1, f"{base}\nunique one\n\n{base}"), (2, f"{near}\n{other}"), (3, f"  {other.upper()}!!\n---\nOnly here"), (4, None), (5, ""), (None, base), (6, base), (6, base)]
    out = lines.deduplicate(docs_of(spark, rows).selectExpr("*", "'s' as line", "7 as n_kept", "8 as gone", "9 as ID", "1 as `Drop`")).collect()
    got = sorted([(str(r.doc_id), r.text, r.n_lines, r.n_kept) for r in out], key=str)
    want = [("1", f"{base}\nunique one\n", 4, 3), ("2", other, 2, 1), ("3", "---\nOnly here", 3, 2), ("4", None, 0, 0), ("5", "", 1, 1), ("6", "", 1, 0), ("6", "", 1, 0), ("None", base, 1, 1)]
    assert got == sorted(want, key=str)
    assert {(r.gone, r.ID, r.Drop) for r in out} == {(8, 9, 1)}
    assert lines.deduplicate(docs_of(spark, [])).collect() == []


def test_very_long_line(spark):
    line = " ".join(f"word{i}" for i in range(100_000))
    rows = [(1, line), (2, line.replace("word77 ", "ward77 ")), (3, line.replace("word88 ", "")), (4, line[:400_000])]
    got = {r.doc_id: r.n_kept for r in lines.deduplicate(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1}


def linked_pairs(unique):
    """All pairs at edit similarity 0.8, found by comparing every two lines."""
    import duckdb
    import pandas as pd

    table = pd.DataFrame({"i": range(len(unique)), "x": unique})
    most = "cast(floor(greatest(length(a.x), length(b.x)) * 0.2 + 1e-9) as int)"
    sql = f"select a.x, b.x from t a join t b on a.i < b.i and abs(length(a.x) - length(b.x)) <= {most} where levenshtein(a.x, b.x) <= {most}"
    with duckdb.connect() as c:
        c.register("t", table)
        return c.execute(sql).fetchall()


def groups_of(unique, pairs):
    parent = {u: u for u in unique}

    def find(u):
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        return u

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {u: find(u) for u in unique}


def found_keeps(spark, docs):
    """Of each normalised line that is not alone, the place that is kept for it."""
    rows = lines.written(lines.line_rows(docs, "doc_id", "text"), "rows")
    keep = {(r.h1, r.h2): tuple(r.keep) for r in lines.line_groups(docs, rows).collect()}
    import xxhash

    signed = lambda u: int.from_bytes(xxhash.xxh64_digest(u.encode(), 42), "big", signed=True)
    return {h1: k for (h1, _), k in keep.items()}, signed


def test_recall_against_edit_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    normal = lambda x: " ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower()) if w)
    unique = sorted({n for r in docs.collect() for x in (r.text or "").split("\n") if (n := normal(x)) and len(n) <= 2000})
    pairs = linked_pairs(unique)
    keeps, signed = found_keeps(spark, docs)
    met = [keeps.get(signed(a), a) == keeps.get(signed(b), b) for a, b in pairs]
    print("pairs", len(pairs), "met", sum(met))
    assert len(pairs) > 20 and sum(met) >= 0.9 * len(pairs)
    # and nothing meets that links do not join
    group, of = groups_of(unique, pairs), {}
    for u in unique:
        if signed(u) in keeps:
            of.setdefault(keeps[signed(u)], set()).add(group[u])
    assert all(len(g) == 1 for g in of.values())


def test_lines_with_a_few_other_words(spark):
    import random

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts = []
    for _ in range(40):
        line = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        for _ in range(rng.choice([1, 1, 1, 4, 12])):
            mine = list(line)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(mine))
                mine[i] = mine[i][:-1] + rng.choice("xyz")
            texts.append(" ".join(mine))
    rng.shuffle(texts)
    rows = [(i, "\n".join(texts[i * 4 : i * 4 + 4])) for i in range((len(texts) + 3) // 4)]
    unique = sorted(set(texts))
    pairs = linked_pairs(unique)
    keeps, signed = found_keeps(spark, docs_of(spark, rows))
    met = [keeps.get(signed(a), a) == keeps.get(signed(b), b) for a, b in pairs]
    print("pairs", len(pairs), "met", sum(met))
    assert len(pairs) > 100 and sum(met) >= 0.9 * len(pairs)


def test_imatch(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in source.collect()] + [(9001, None), (9000, ""), (9002, "..."), (9003, "Tiny text"), (9004, "Tiny text")]
    out = {r.doc_id: r for r in imatch.edited_likeness(docs_of(spark, rows).selectExpr("*", "1 as id", "2 as h")).collect()}
    assert sorted(out) == sorted(r[0] for r in rows)
    order = sorted(rows, reverse=True)
    by_text = {}
    for at, (doc, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = out[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    mean = lambda c: sum(getattr(r, c) for r in out.values()) / len(out)
    assert mean("near_edited") > mean("near_next") + 0.25
    assert imatch.edited_likeness(docs_of(spark, [])).collect() == []
    twice = imatch.edited_likeness(docs_of(spark, [(1, "b c"), (1, "a b"), (None, "x")])).collect()
    assert [(r.doc_id, r.n_chars) for r in twice] == [(1, 3)] and twice[0].near_next == 1


CARD = "4539 1488 0343 6467"


def luhn_ok(number):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in number if c.isdigit()])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_pseudonyms_keep_format_link_and_invert(spark):
    text = f"Call +1 (555) 010-9999, born 1987-02-28, card {CARD}, id 123-45-6789, host 10.0.200.7, ann.lee42@mail8.example.com."
    rows = [(1, text), (2, "again 1987-02-28 and " + CARD), (3, None), (4, ""), (5, "1234 5678 1234 5678 2023-02-30 999.1.1.1 1.2.3"), (6, text), (7, "10.0.200.7")]
    docs = docs_of(spark, rows).selectExpr("*", "'c' as m", "1 as n_ip")
    made = pii.pseudonymise(docs, "k'1\\")
    got = {r.doc_id: r for r in made.collect()}
    assert made.columns[:3] == ["doc_id", "text", "m"]
    assert re.sub(r"[0-9]", "9", got[1].text.split(", host")[0]) == re.sub(r"[0-9]", "9", text.split(", host")[0])
    card = re.search(r"card ([\d ]{19})", got[1].text)[1]
    assert card != CARD and luhn_ok(card) and card in got[2].text
    day = re.search(r"born (\S{10}),", got[1].text)[1]
    assert day != "1987-02-28" and day in got[2].text and "1600" <= day < "2000"
    assert re.search(r"[a-z0-9]{3}\.[a-z0-9]{5}@mail8\.example\.com\.$", got[1].text) and "ann.lee42" not in got[1].text
    assert got[7].text in got[1].text and got[7].text.count(".") == 3 and got[7].n_ip == 1
    assert got[1].text == got[6].text and got[3].text is None and got[4].text == "" and got[5].text == rows[4][1]
    assert (got[1].n_email, got[1].n_date, got[1].n_ip, got[1].n_phone, got[1].n_national_id, got[1].n_card) == (1, 1, 1, 1, 1, 1)
    assert got[3].n_card == got[5].n_card == 0
    back = {r.doc_id: r.text for r in pii.pseudonymise(made.select("doc_id", "text"), "k'1\\", inverse=True).collect()}
    assert back == dict(rows)
    assert pii.pseudonymise(docs.limit(0), "k").collect() == []


@pytest.mark.parametrize(("a", "b"), [(10, 10), (1, 10), (189, 773)])
def test_feistel_is_a_permutation(spark, a, b):
    n = a * b
    sql = pii.feistel("id", "'key'", "'t'", str(a), str(b))
    moved = spark.range(n).selectExpr(f"{sql} as x")
    assert moved.distinct().count() == n and moved.selectExpr("min(x)", "max(x)").first()[:] == (0, n - 1)
    assert moved.selectExpr(f"{pii.feistel('x', repr('key'), repr('t'), str(a), str(b), inverse=True)} as y").distinct().count() == n
