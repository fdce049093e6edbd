"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents, in SQL functions only.

A window is a run of consecutive item words (an item of fewer words is one window). Its words are ordered by rarity in
the documents; as a window must be contained whole, its necessary prefix is its rarest word alone. Documents' words are
joined to the prefixes; the prefix's place in the window and the document's length bound where the window can lie; what
is left is verified word by word in the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
ONE_IN = 20
#: Windows to a broadcast (a few hundred bytes each); more windows take more passes over the documents.
PASS_WINDOWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: F.Column) -> F.Column:
    """Words of a text: ASCII letters lower-cased, runs of ASCII digits and letters and all other characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows_of(bench: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, words)``: the distinct windows of each item, as word arrays."""
    items = bench.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return items.select("item", F.explode(starts).alias("at"), "all").select("item", F.slice("all", F.col("at"), window).alias("words")).distinct()


def prefixes(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """``(word, before, wid, words)``: each distinct window with its rarest word over all documents and its place."""
    whole = written(windows.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    places = whole.select("wid", F.posexplode("words").alias("before", "word"))
    vocabulary = small_side(written(places.select("word").distinct(), "vocabulary"))
    counts = docs.select(F.explode(words_of(F.col(text_col))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "before")
    rarest = places.join(counts, "word", "left").groupBy("wid").agg(F.min(rarity).alias("first"))
    return whole.join(rarest, "wid").select(F.col("first.word").alias("word"), F.col("first.before").alias("before"), "wid", "words")


def hits(docs: DataFrame, prefix: DataFrame, id_col: str, text_col: str, passes: int) -> DataFrame:
    """``(id, text_hash, start, length, wid)``: every occurrence of a window in a document, once."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("all"))
    at = rows.select("id", "text_hash", "all", F.posexplode("all").alias("place", "word"))
    found = None
    for k in range(passes):
        part = prefix.where(F.pmod(F.xxhash64("wid"), F.lit(passes)) == k) if passes > 1 else prefix
        start = F.col("place") - F.col("before")
        inside = (start >= 0) & (start + F.size("words") <= F.size("all"))
        same = F.slice("all", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words")
        one = at.join(F.broadcast(part), "word").where(inside).where(same).select("id", "text_hash", start.alias("start"), F.size("words").alias("length"), "wid")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def contamination(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, items, contaminated`` for every row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` lists the ids (as sorted strings) of the items
    with occurring windows. Null or wordless texts have no words and no hits; such items have no windows; items may be
    repeated or equal. Repeated rows give repeated results; null ids are kept. Other columns are ignored. Empty tables
    give empty results, or no hits.
    """
    windows = written(windows_of(bench, item_col, text_col, window), "item-windows")
    prefix = written(prefixes(docs, windows, text_col), "prefixes")
    passes = max(1, -(-prefix.count() // PASS_WINDOWS))
    found = written(hits(docs, prefix, id_col, text_col, passes), "hits")
    key = ["id", "text_hash"]
    ordered = Window.partitionBy(*key).orderBy("start", "length", "wid").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(ordered), F.lit(0))), F.lit(0))
    words = found.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    names = prefix.select("wid", "words").join(windows, "words").select("wid", F.col("item").cast("string").alias("item"))
    items = found.select(*key, "wid").distinct().join(small_side(written(names, "names")), "wid").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select(F.col("id").alias("id2"), F.col("text_hash").alias("hash2"), "items")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("text_hash") == F.col("hash2"))
    marks = written(words.join(items, same).select("id", "text_hash", "n_hit", "items"), "marks")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = base.join(marks, base["doc_id"].eqNullSafe(marks["id"]) & (base["text_hash"] == marks["text_hash"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", base["text_hash"], "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated rows."""
    marks = contamination(docs, bench, id_col=id_col, text_col=text_col, **options).where("contaminated")
    gone = written(marks.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_hash"])
    return docs.join(small_side(gone), same, "left_anti")
