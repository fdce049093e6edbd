"""Chat formatting, language ID, sharding, SimHash, packing and token counts against plain Python."""

import hashlib
import json
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, components, langid, lengths, packing, queries, shards, simhash
from gridloom.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.001"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def encode():
    return Encoder(default_path())


# chat


@pytest.mark.parametrize("text", ["", "plain", CONTROL, "<\\|im_end|>", "<\\\\|x", "<||>", "a<|b\\<|", "<|\n<|im_start|>user\n"])
def test_template_is_reversible(text):
    turns = [("user", text), ("assistant", text), ("odd\nrole%0A<|", text)]
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text]
    assert formatted.count("<|im_start|>") == 3 and formatted.count("<|im_end|>") == 3


def test_layouts_become_the_same_turns(spark):
    turns = [["user", "Q"], ["assistant", "A"]]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in turns]},
        {"conv_id": 4, "messages": [{"role": r, "text": t} for r, t in turns]},
        {"conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]},
        {"instruction": "Q", "output": "A"},
        {"prompt": "Q", "response": "A", "source": "x"},
        {"prompt": "Q", "completion": "A"},
        {"question": "Q", "answer": "A"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    odd = [(100, None), (101, "{"), (102, '{"foo": 1}'), (103, '{"messages": []}'), (104, '{"instruction": null, "input": "I", "output": "A"}'), (104, '{"question": "", "answer": null}'), (None, '["x"]')]
    df = spark.createDataFrame(rows + odd, "conv_id long, record string").selectExpr("*", "'z' as formatted")
    got = {}
    for r in chat.format_records(df).collect():
        got.setdefault(r.conv_id, []).append(r)
    for i in range(len(records)):
        assert chat.parse_turns(got[i][0].formatted) == [tuple(t) for t in turns]
    assert len({got[i][0].schema_hash for i in range(len(records))}) == len(records)
    assert [got[i][0].mapping for i in (100, 101, 102, 103, None)] == [None, None, None, "messages", None]
    assert sorted(r.n_turns for r in got[104]) == [2, 3] and got[102][0].formatted == ""
    assert chat.format_records(df.limit(0)).collect() == []


def test_conversations_query(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    rows[-1] = [(0, "user", CONTROL), (1, "assistant", CONTROL)]
    got = {r.conv_id: r for r in queries.op1_chat_formatting(spark, SF).collect()}
    assert set(got) == set(rows)
    for k, turns in rows.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learnt = "".join(text for _, role, text in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), sha(whole), len(learnt), sha(learnt))


def test_records_from_turns_edges(spark):
    df = spark.createDataFrame([(1, 2, "assistant", None), (1, 1, None, "x"), (1, None, "user", "first"), (1, 1, "b", "y"), (1, 1, "b", "y")], "conv_id long, turn long, role string, text string")
    (r,) = chat.records_from_turns(df).collect()
    assert [(m["role"], m["content"]) for m in json.loads(r.record)["messages"]] == [("user", "first"), ("", "x"), ("b", "y"), ("b", "y"), ("assistant", "")]


# language ID


def test_language_id(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(source.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == source.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_id_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the end", "en"), ("la fin", "fr"), ("words", None), (None, "en"), ("123 !!", "fr")])]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string").selectExpr("*", "0 as score", "array(1) as weights")
    model = langid.fit(langid.labelled_sample(df, F.lit(True)))
    assert model.languages == ["en", "fr"]
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "weights", "lang_pred", "score"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 8 and by[0].lang_pred == "en" and by[1].lang_pred == "fr"
    assert (by[5].lang_pred, by[5].score) == (by[6].lang_pred, by[6].score) == ("und", 0.0)
    empty = langid.fit(langid.labelled_sample(df.limit(0), F.lit(True)))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).collect() == []
    long = "the dog and the cat " * 200_000
    assert model.predict([long])[0] == ["en"]


def test_kernel_counts_shared_grams():
    def spectrum(t):
        raw = bytes(langid._CLASS[np.frombuffer((" " + t.lower() + " ").encode(), np.uint8)])
        return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}

    import pandas as pd

    texts = ["The cat.", "Der Hund!", "el gato", "cats and dogs"]
    model = langid.fit(pd.DataFrame({"text": texts, "lang": ["en", "de", "es", "en"]}))
    x = model.presence(texts)
    assert (x @ x.T == [[len(spectrum(a) & spectrum(b)) for b in texts] for a in texts]).all()


# sharding


def test_table_is_even_and_moves_little():
    names = [f"s{i}" for i in range(10)]
    table = shards.lookup_table(names, 1009)
    counts = np.bincount(table, minlength=10)
    assert counts.sum() == 1009 and counts.max() - counts.min() <= 1
    fewer = shards.lookup_table(names[:-1], 1009)
    assert (fewer[table < 9] != table[table < 9]).mean() < 0.25
    assert [names[i] for i in table] == [names[::-1][i] for i in shards.lookup_table(names[::-1], 1009)]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            shards.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        shards.lookup_table(names, 1000)


def test_placement(spark):
    import xxhash

    names = ["a", "b", "c"]
    table = shards.lookup_table(names, 101)
    rows = [("x", 1), ("x", 2), (None, 3), ("", 4), ("é", 5), ("x", 1)]
    df = spark.createDataFrame(rows, "key string, slot long").selectExpr("*", "'old' as shard", "'k' as other")
    got = shards.place(df, "key", names, 101)
    assert got.columns == ["key", "other", "slot", "shard"] and got.count() == 6
    for r in got.collect():
        slot = np.int64(np.uint64(xxhash.xxh64_intdigest((r.key or "").encode(), 42)).astype(np.int64)) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert shards.place(df.limit(0), "key", names, 101).collect() == []
    assert shards.place(spark.range(2000).selectExpr("'hot' as key", "id"), "key", names, 101, spread_by="id").select("shard").distinct().count() == 3


# SimHash


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    ids, comp = [r[0] for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    low = {}
    for i, c in zip(ids, comp, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return Counter((i, f"{f:016x}", low.get(c)) for i, f, c in zip(ids, fps, comp, strict=True))


def test_simhash_equals_brute_force(spark):
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = source + [(1001, None), (1000, " \t"), (1002, "One"), (1003, "one TWO"), (1004, "one two"), (None, source[5][1]), (None, "alone here now"), (3, source[3][1]), (1005, "ÉTÉ a b c")]
    got = simhash.near_duplicates(docs_of(spark, rows).selectExpr("*", "0 as fp", "1 as id"))
    found = Counter((r.id, r.hex, r.component_id) for r in got.select("id", simhash.hex16(F.col("fp")).alias("hex"), "component_id").collect())
    assert found == brute_components(rows)
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []


def test_golay_keys_miss_no_link(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))) for b in base]
    for fps, others in ((base, near), (near, base)):
        a, b = np.array(fps, np.uint64), np.array(others, np.uint64)
        rows, keys = simhash.probe_keys(a)
        probe = {i: set(keys[rows == i].tolist()) for i in range(len(a))}
        rows, keys = simhash.own_keys(b)
        assert all(probe[i] & set(keys[rows == i].tolist()) for i in range(len(a)))
        assert max(map(len, probe.values())) <= 3 * 36


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    high, low, errors = simhash._tables()
    nearest = words ^ errors[high[words >> 12] ^ low[words & 0xFFF]]
    assert len(np.unique(nearest)) == 1 << 12 and np.bitwise_count(words ^ nearest).max() == 3


def test_keep_one(spark):
    text = "a long enough text about nothing in particular that repeats"
    df = docs_of(spark, [(5, text), (2, text.upper()), (3, "something else entirely is written here"), (4, ""), (6, None), (None, text)]).selectExpr("*", "'l' as lang")
    assert sorted((str(r.doc_id) for r in simhash.keep_one(df).collect())) == ["2", "3", "4", "None"]
    assert simhash.keep_one(df).columns == df.columns


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (501, 500), (7, 7), (500, 500), (900, 901)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 500: 500, 501: 500, 900: 900, 901: 900}
    hub = spark.range(1, 3000).selectExpr("id as src", "0L as dst")
    assert components.connected_components(hub).groupBy("component").count().collect()[0]["count"] == 3000


# tokens, packing, lengths


@pytest.mark.parametrize("text", [None, "", " ", "  ", "a  b", "a   b", "a \n b", "a\n ", "a\n  b", " lead", "trail ", "a<|endoftext|>b", "don't ''s", "a  b", "\n\n a", "12a é½ x　y", "\x1c a \x85 b", "日本 語 🙂 x"])
def test_ids_equal_the_tokenizer(encode, text):
    assert encode.ids(text) == encode.whole(text or "")
    assert encode.count(text) == len(encode.whole(text or ""))


def test_ids_equal_on_documents(spark, encode, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert all(encode.ids(t) == encode.whole(t) for t in texts)
    monkeypatch.setattr("gridloom.llm.tokens.MEMO", 50)
    assert all(encode.ids(t) == encode.whole(t) for t in texts[:50])


def test_packing(spark, encode):
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = source + [(5000, None), (5001, ""), (5002, "word " * 5000), (5003, "x"), (5003, "x"), (None, "y")]
    out = packing.pack(docs_of(spark, rows).selectExpr("*", "1 as piece", "2 as rank")).collect()
    want = Counter()
    for doc, text in rows:
        ids = encode.whole(text or "") + [2]
        first, start, piece = (len(ids) - 1) % 1024 + 1, 0, 0
        while start < len(ids):
            end = first if piece == 0 else start + 1024
            want[(doc, piece, start, end - start, zlib.crc32(struct.pack(f"<{end - start}I", *ids[start:end])))] += 1
            start, piece = end, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in out)
    assert len(sequences) <= -(-total // 1024) * 1.01 + 1
    assert packing.pack(docs_of(spark, [])).collect() == []


def test_plan_holds_the_histogram():
    rng = random.Random(3)
    for _ in range(5):
        histogram = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 3000)))
        made = Counter()
        planned = packing.plan(histogram, 64)
        for config, n in planned:
            assert n > 0 and sum(a * b for a, b in config.items()) <= 64
            for length, times in config.items():
                made[length] += n * times
        assert made == histogram
        assert sum(n for _, n in planned) <= sum(n for _, n in packing.fill(histogram, 64)) * 1.005 + 2
    assert packing.plan({}, 64) == []


def test_token_counts(spark, encode):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [None, "", "word " * 9000]
    n = [len(encode.whole(t or "")) + 1 for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("*", "0 as length")
    table = lengths.limit_table(lengths.length_histogram(lengths.encoded_lengths(df)))
    got = table.collect()
    assert sorted(r.context_limit for r in got) == sorted(set(n))
    for r in got:
        fit = [x for x in n if x <= r.context_limit]
        kept = sum(min(x, r.context_limit) for x in n)
        assert (r.n_docs, r.n_fit, r.tokens_fit, r.n_over, r.kept_tokens, r.lost_tokens) == (n.count(r.context_limit), len(fit), sum(fit), len(n) - len(fit), kept, sum(n) - kept)
        assert (r.total_docs, r.total_tokens, r.quantile) == (len(n), sum(n), len(fit) / len(n))
    for limit in (0, 1, 100, 10**6):
        assert lengths.truncated_total(table, limit).first()[0] == sum(min(x, limit) for x in n)
    assert lengths.quantile_length(table, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]
    none = lengths.limit_table(lengths.length_histogram(lengths.encoded_lengths(df.limit(0))))
    assert none.collect() == [] and lengths.truncated_total(none, 9).first()[0] is None
