"""The thin queries of the training-data operators: whole tables in, full results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps, chat, decontam, imatch, langid, lengths, lines, merkle, packing, pii, shards, simhash, toxicity
from .common import documents

#: Key of the pseudonyms in these queries; a deployment passes its own.
PII_KEY = "example-key"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -1L as conv_id, to_json(named_struct('prompt', t, 'response', t)) as record from (select :t as t)", args={"t": CONTROL})
    records = chat.records_from_turns(turns).unionByName(extra)
    return chat.digest(chat.format_records(records))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir, "doc_id", "text"), PII_KEY)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(langid.labelled_sample(docs, ~held_out))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(documents(spark, sf_dir, "doc_id", "source"), "doc_id").select("doc_id", "source", "slot", "shard")


def op5_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(documents(spark, sf_dir, "doc_id", "text"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_lines", "n_kept", "text")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limit_table(lengths.length_histogram(lengths.encoded_lengths(documents(spark, sf_dir, "text"))))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their 120 orders, by language."""
    return bitmaps.interactions(bitmaps.audited_rows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; labels of rows whose CRC-32 divides by 5 are never read."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle tree of the table by source, with a proof of every row and what tampered rows fold to."""
    found = merkle.audited(merkle.document_records(documents(spark, sf_dir)))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_feistel_pseudonyms, op3_language_id, op4_shard_lookup, op5_imatch_fingerprints,
        op6_fuzzy_lines, op7_simhash_golay, op8_best_fit_packing, op9_benchmark_decontamination, op10_token_counts,
        op11_filter_interactions, op12_toxicity, op13_merkle_manifest,
    )
}
_PRINTS = {name: chat.schema_fingerprint(paths) for name, paths in (("messages", ["messages[].role", "messages[].content"]), ("prompt_response", ["prompt", "response"]))}

#: Hashes of other kinds, tokenizers and models are not stated in SQL; those queries are tested against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
      CASE WHEN conv_id = -1 THEN '{_PRINTS["prompt_response"]}' ELSE '{_PRINTS["messages"]}' END AS schema_hash, CASE WHEN conv_id = -1 THEN 'prompt_response' ELSE 'messages' END AS mapping
    FROM t GROUP BY conv_id""",
    "op9_benchmark_decontamination": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g, len(list_slice(w, i, i + 12)) AS n FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
    p AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
    h AS (SELECT DISTINCT doc_id, i, p.n, item_id FROM p JOIN g ON g.n = p.n AND g.g = array_to_string(list_slice(w, i, i + p.n - 1), ' ')),
    c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM h) GROUP BY 1),
    m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op11_filter_interactions": r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
    l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
      'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS fails FROM w LEFT JOIN l USING (doc_id)),
    o(o) AS (SELECT '' UNION ALL SELECT o || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)),
    s AS (SELECT o AS filter_order, i::INT AS step, o[i] AS filter, o[:i - 1] AS before FROM o, generate_series(1, 5) g(i) WHERE length(o) = 5),
    c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
    r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT gone AND NOT fails[filter] THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails[filter] THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN gone AND fails[filter] THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails[filter] AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT gone AND fails[filter] AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails[filter] AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM (SELECT *, len(list_filter(map_values(fails), lambda x: x)) AS n_fails, len(list_filter(string_split(before, ''), lambda x: x <> '' AND coalesce(fails[x], false))) > 0 AS gone FROM c, s) GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r""",
    "op13_merkle_manifest": r"""WITH RECURSIVE x AS (SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384)))) AS crc FROM documents),
    h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered FROM x),
    i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM h),
    t AS (SELECT source, 0 AS lv, list(leaf ORDER BY idx) AS nodes FROM i GROUP BY 1
      UNION ALL SELECT source, lv + 1, list_transform(range(0, len(nodes), 16), lambda k: sha256(array_to_string(nodes[k + 1 : k + 16], ''))) FROM t WHERE len(nodes) > 1),
    sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS sat FROM t WHERE len(nodes) = 1),
    u AS (SELECT 0 AS lv, (SELECT list(subroot ORDER BY sat) FROM sub) AS nodes WHERE EXISTS (SELECT 1 FROM sub)
      UNION ALL SELECT lv + 1, list_transform(range(0, len(nodes), 16), lambda k: sha256(array_to_string(nodes[k + 1 : k + 16], ''))) FROM u WHERE len(nodes) > 1),
    lower_way AS (SELECT i.doc_id, i.leaf, t.lv, t.nodes[(idx >> (4 * t.lv)) // 16 * 16 + 1 : (idx >> (4 * t.lv))] AS l, t.nodes[(idx >> (4 * t.lv)) + 2 : (idx >> (4 * t.lv)) // 16 * 16 + 16] AS r FROM i JOIN t ON t.source IS NOT DISTINCT FROM i.source WHERE len(t.nodes) > 1),
    upper_way AS (SELECT i.doc_id, i.leaf, 100 + u.lv AS lv, u.nodes[(sat >> (4 * u.lv)) // 16 * 16 + 1 : (sat >> (4 * u.lv))] AS l, u.nodes[(sat >> (4 * u.lv)) + 2 : (sat >> (4 * u.lv)) // 16 * 16 + 16] AS r FROM i JOIN sub ON sub.source IS NOT DISTINCT FROM i.source, u WHERE len(u.nodes) > 1),
    p AS (SELECT doc_id, leaf, list({'l': array_to_string(l, ''), 'r': array_to_string(r, '')} ORDER BY lv) AS way FROM (FROM lower_way UNION ALL FROM upper_way) GROUP BY 1, 2),
    g AS (SELECT i.doc_id, i.leaf, tampered AS node, coalesce(way, []) AS way, 1 AS step FROM i LEFT JOIN p ON p.doc_id IS NOT DISTINCT FROM i.doc_id AND p.leaf = i.leaf
      UNION ALL SELECT doc_id, leaf, sha256(way[step].l || node || way[step].r), way, step + 1 FROM g WHERE step <= len(way))
    SELECT g.doc_id, g.leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda y: y.l || y.r), '')) AS proof_sha256, node AS folded_root, node = root AS verified
    FROM g JOIN i ON i.doc_id IS NOT DISTINCT FROM g.doc_id AND i.leaf = g.leaf JOIN sub ON sub.source IS NOT DISTINCT FROM i.source, (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1) WHERE step = len(way) + 1""",
}
