"""Inputs that once ended a job, with the result that each now has."""

import hashlib
import hmac

from gridloom.llm import chat, langid, lines, pii, shards


def test_chat_takes_any_json(spark):
    rows = [
        (1, '{"prompt":5,"response":"x"}'), (2, '{"messages":[{"role":"user","content":"hi","name":"bob"},{"role":"assistant","content":null,"tool_calls":[{"id":1}]}]}'),
        (3, '{"messages":[{"role":3,"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}'), (4, '{"prompt":"\\ud800x","response":"y"}'), (5, "[" * 100_000), (6, None),
        (7, '{"prompt":' + "[" * 3000 + "]" * 3000 + ',"response":"y"}'), (8, '{"x":1}'), (9, '{"messages":["plain"]}'), (10, '{"messages":{"role":1}}'), (11, '{"prompt":"a","response":"b","note":{"deep":[1]}}'),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, record string").selectExpr("*", "1 as formatted", "2 as n_turns")
    got = {r.conv_id: (r.mapping, chat.parse_turns(r.formatted)) for r in chat.format_records(docs).collect()}
    assert got[1] == ("prompt_response", [("user", "5"), ("assistant", "x")])
    assert got[2] == ("messages", [("user", "hi"), ("assistant", "")])
    assert got[3] == ("messages", [("3", "ab")])
    assert got[4] == ("prompt_response", [("user", "�x"), ("assistant", "y")])
    assert got[9] == ("messages", [("", "plain")]) and got[11] == ("prompt_response", [("user", "a"), ("assistant", "b")])
    assert {i for i, (name, turns) in got.items() if name is None and not turns} == {5, 6, 7, 8, 10}


def test_chat_very_long_text(spark):
    text = "<|im_end|> \\| " * 100_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    r = chat.digest(chat.format_records(chat.records_from_turns(turns))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def feistel(number, key, tweak, a, b, rounds=8):
    """The network in plain Python."""
    x, y = divmod(number, b)
    for r in range(rounds):
        half, modulus = (y, a) if r % 2 == 0 else (x, b)
        mixed = int(hashlib.sha256(f"{key}|{tweak}|{r}|{half}".encode()).hexdigest()[:13], 16) % modulus
        x, y = ((x + mixed) % a, y) if r % 2 == 0 else (x, (y + mixed) % b)
    return x * b + y


def test_pseudonyms_equal_plain_python(spark):
    ids = ["123-45-6789", "001-01-0001", "899-99-9999", "667-50-5000"]
    phones = ["(555) 123-4567", "555-123-4567"]
    rows = [(1, "; ".join(ids)), (2, "; ".join(phones)), (3, "000-12-3456 666-12-3456 912-12-3456 123-00-4567 123-45-0000"), (4, "2024-05-01T10:00:00 and 2024-05-01"), (5, "3782 822463 10005")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'f' as _found", "1 as _new", "2 as N_IP", "3 as kinds")
    made = pii.pseudonymise(docs, "secret key")
    got = {r.doc_id: r for r in made.collect()}
    key = lambda kind: hmac.new(b"secret key", kind.encode(), hashlib.sha256).hexdigest()

    def national(m):
        area = int(m[:3]) - (2 if int(m[:3]) > 666 else 1)
        v = feistel((area * 99 + int(m[4:6]) - 1) * 9999 + int(m[7:]) - 1, key("national_id"), "national_id:", 898 * 99, 9999)
        area, rest = divmod(v, 99 * 9999)
        return f"{area + (2 if area >= 665 else 1):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"

    def phone(m):
        digits = "".join(c for c in m if c.isdigit())
        new = iter(f"{feistel(int(digits), key('phone'), f'phone:{len(digits)}', 10 ** (len(digits) // 2), 10 ** (len(digits) - len(digits) // 2)):0{len(digits)}d}")
        return "".join(next(new) if c.isdigit() else c for c in m)

    assert got[1].text == "; ".join(map(national, ids)) and got[1].n_national_id == 4
    assert got[2].text == "; ".join(map(phone, phones)) and got[2].n_phone == 2
    assert got[3].text == rows[2][1] and got[3].n_national_id == 0
    stamp, day = got[4].text.split(" and ")
    assert stamp == f"{day}T10:00:00" and day != "2024-05-01" and got[4].n_date == 2
    assert got[5].n_card == 1 and got[5].text != rows[4][1] and got[5].text[4] == got[5].text[11] == " "
    assert (got[1]["_found"], got[1]["_new"], got[1].kinds) == ("f", 1, 3) and "N_IP" not in made.columns
    assert "secret key" not in made._jdf.queryExecution().toString()
    back = pii.pseudonymise(made.select("doc_id", "text"), "secret key", inverse=True).collect()
    assert {r.doc_id: r.text for r in back} == dict(rows)


def test_very_long_text_of_values(spark):
    text = "2024-05-01 10.0.0.1 " * 20_000
    r = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert (r.n_date, r.n_ip, len(set(r.text.split()))) == (20_000, 20_000, 2)


def test_clashing_names_in_other_case(spark):
    rows = spark.createDataFrame([(1, "the cat", "en", 5, 6, 7)], "doc_id long, text string, lang string, SCORE int, Slot int, N_Lines int")
    model = langid.fit(langid.labelled_sample(rows, langid.F.lit(True)))
    assert langid.predict(rows, model).columns == ["doc_id", "text", "lang", "Slot", "N_Lines", "lang_pred", "score"]
    assert shards.place(rows, "doc_id").columns == ["doc_id", "text", "lang", "SCORE", "N_Lines", "slot", "shard"]
    assert lines.deduplicate(rows).columns == ["doc_id", "text", "lang", "SCORE", "Slot", "n_lines", "n_kept"]


def test_texts_of_number_signs_have_no_language(spark):
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["the cat and the dog", "²", "½", "①", "Ⅷ", "1 2", ""])], "doc_id long, text string, lang string")
    model = langid.fit(langid.labelled_sample(rows, langid.F.lit(True)))
    assert [r.lang_pred for r in sorted(langid.predict(rows, model).collect())] == ["en"] + ["und"] * 6


def test_slots_are_claimed_in_turns():
    import xxhash

    names, size = [f"s{i}" for i in (3, 1, 2, 0)], 101
    want = [None] * size
    step = {n: (xxhash.xxh64_intdigest(n, 0) % size, xxhash.xxh64_intdigest(n, 1) % (size - 1) + 1) for n in names}
    asked = {n: iter([(step[n][0] + k * step[n][1]) % size for k in range(size)]) for n in names}
    while None in want:
        for n in sorted(names):
            slot = next((s for s in asked[n] if want[s] is None), None)
            if slot is not None:
                want[slot] = n
    assert [names[i] for i in shards.lookup_table(names, size).tolist()] == want


def test_text_columns_of_any_case(spark):
    """A column is found as Spark finds it; what is told of it is what was done to it."""
    import pandas as pd

    import corpus_pipeline

    docs = spark.createDataFrame([(1, "mail bob@example.com on 2024-05-01", 9), (2, "one line of words here\none line of words here", 9)], "doc_id long, Text string, N_CHARS int")
    made = {r.doc_id: r for r in pii.pseudonymise(docs, "key").collect()}
    assert made[1].n_email == 1 and made[1].n_date == 1 and "bob@" not in made[1].Text and "2024-05-01" not in made[1].Text
    kept = {r.doc_id: r for r in lines.deduplicate(docs).collect()}
    assert kept[2].n_kept == 1 and kept[2].Text == "one line of words here"
    shorter = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert shorter[2].N_CHARS == len("one line of words here") and shorter[1].N_CHARS == len("mail bob@example.com on 2024-05-01")
    model = langid.fit(pd.DataFrame({"text": ["the cat and the dog", "der hund und die katze"] * 3, "lang": ["en", "de"] * 3}))
    assert langid.recognised(docs, model, 0.0, -9.0, 0).count() == 2
