"""I-Match fingerprints, in SQL functions only.

A document's terms within a band of document frequency are kept, sorted, and hashed once for each of several randomised
lexicon subsets. Subsets come in levels: level k draws from a random 4**-k of the lexicon, split into 16 subsets, so
that short and long documents alike have subsets with about one term of theirs. A fingerprint is the concatenation of
all subsets' hashes; a likeness is the share of subsets that agree, at the level where two documents agree most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written

#: Band of document frequency, as shares of all documents: at least RARE, at most COMMON.
RARE, COMMON = 1 / 2000, 0.2
LEVELS, SUBSETS = 6, 16
#: Hex digits of a subset's hash, and what stands for a subset without terms of the document.
DIGITS = 4
EMPTY = "-" * DIGITS
#: A level counts if the two documents have terms in this many of its subsets.
LEAST = 4
#: A text with fewer terms in the band than this is given others of its own up to this many, by the order of their hashes.
FEWEST = 20


def terms_of(text: F.Column) -> F.Column:
    """The distinct terms of a text: lower-cased runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def lexicon(texts: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """``(h)``: hashes of the terms in the band, from counts over all rows of ``texts`` (a column ``text``).

    Its size is bounded by the mean number of distinct terms divided by ``rare``, whatever the number of documents.
    """
    n = texts.count()
    counts = texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("df"))
    return counts.where(F.col("df").between(max(1.0, rare * n), max(1.0, common * n))).select("h")


def next_ids(ids: DataFrame) -> DataFrame:
    """``(id, next_id)``: the next smaller id, and for the smallest the largest (itself if it is alone).

    Ids are dealt by range, so that only each range's ends meet in one task: one row for each shuffle partition.
    """
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = written(ids.select("id").repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ids")
    near = dealt.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id"))))
    ends = dealt.groupBy("part").agg(F.max("id").alias("top"))
    order, whole = Window.orderBy("part"), Window.partitionBy()
    ends = ends.select("part", F.coalesce(F.lag("top").over(order), F.max("top").over(whole)).alias("below"))
    return near.join(F.broadcast(ends), "part").select("id", F.coalesce("next_id", "below").alias("next_id"))


def chosen_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows ``(id, kind, h, note)`` to ``(id, kind, chosen, note)``: the terms of each text that are hashed.

    These are its terms in the band, and where they are fewer than FEWEST, those of its others that come first in the
    order of a hash: one rule at every length, under which texts alike choose alike. Only a text without terms has none.
    """
    known = small_side(terms.withColumn("known", F.lit(True)))
    inside, given = F.col("known").isNotNull(), F.col("h").isNotNull()
    order = F.struct(F.xxhash64("h", F.lit(11)).alias("order"), "h")
    whole = rows.join(known, "h", "left").groupBy("id", "kind").agg(
        F.collect_list(F.when(inside, F.col("h"))).alias("band"), F.collect_list(F.when(given & ~inside, order)).alias("rest"), F.max("note").alias("note")
    )
    more = F.slice(F.sort_array("rest"), F.lit(1), F.greatest(F.lit(FEWEST) - F.size("band"), F.lit(0)))
    return whole.select("id", "kind", F.concat("band", F.transform(more, lambda x: x["h"])).alias("chosen"), "note")


def subset_rows(rows: DataFrame) -> DataFrame:
    """Rows ``(id, kind, chosen, note)`` to a row for each subset that a term belongs to; notes keep subset -1."""
    rows = rows.select("id", "kind", "note", F.posexplode_outer("chosen").alias("at", "h"))
    rows = rows.select("id", "kind", "h", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("note")).alias("note"))
    draw = F.xxhash64("h", F.lit(7))
    zeros = F.bit_count(draw.bitwiseAND(F.negate(draw)) - 1)
    levels = F.when(F.col("h").isNotNull(), F.least(F.floor(zeros / 2).cast("int") + 1, F.lit(LEVELS))).otherwise(0)
    first = F.when(F.col("note").isNotNull(), -1).otherwise(0)
    subset = F.pmod(F.shiftrightunsigned(draw, 40), F.lit(SUBSETS)).cast("int")
    rows = rows.select("id", "kind", "h", "note", first.alias("first"), (levels - 1).alias("last"), subset.alias("part"))
    rows = rows.where("last >= first").select("id", "kind", "h", "note", "part", F.explode(F.sequence("first", "last")).alias("level"))
    inside = F.col("level") >= 0
    return rows.select(
        "id", "kind", F.when(inside, F.col("level") * SUBSETS + F.col("part")).otherwise(-1).alias("subset"), F.when(inside, F.col("h")).alias("h"), F.when(~inside, F.col("note")).alias("note")
    )


def fingerprints(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(id, kind, text, note)`` to ``(id, kind, marks, note)``: the hashes of all subsets, as an array.

    Terms of a text are looked up and grouped where the text is, if the input is already dealt by id.
    """
    terms_in = terms_of(F.col("text"))
    rows = texts.select("id", "kind", "note", terms_in.alias("terms"))
    rows = rows.select("id", "kind", "note", F.posexplode_outer("terms").alias("at", "term"))
    note = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("note"))
    rows = rows.select("id", "kind", F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("h"), note.alias("note"))
    parts = subset_rows(chosen_terms(rows, terms)).groupBy("id", "kind", "subset").agg(F.sort_array(F.collect_list("h")).alias("sorted"), F.max("note").alias("note"))
    mark = F.substring(F.lower(F.lpad(F.hex(F.xxhash64("sorted")), 16, "0")), 1, DIGITS)
    cell = F.when(F.col("subset") >= 0, F.struct(F.col("subset"), mark.alias("mark")))
    whole = parts.groupBy("id", "kind").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"), F.max("note").alias("note"))
    every = F.sequence(F.lit(0), F.lit(LEVELS * SUBSETS - 1))
    marks = F.transform(every, lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(EMPTY)))
    return whole.select("id", "kind", marks.alias("marks"), "note")


def likeness(a: str, b: str) -> F.Column:
    """Share of agreeing subsets among those with terms of either, at the level where it is largest; 1 if all are empty:
    only texts without terms have no subset."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 0).when(x == y, 1001).otherwise(1))
    sums = [F.aggregate(F.slice(both, k * SUBSETS + 1, SUBSETS), F.lit(0), lambda s, v: s + v) for k in range(LEVELS)]
    seen, same = [s % 1000 for s in sums], [F.floor(s / 1000) for s in sums]
    shares = [F.when(n >= (LEAST if k else 1), m / n) for k, (m, n) in enumerate(zip(same, seen, strict=True))]
    return F.coalesce(F.greatest(*shares), F.lit(1.0)).cast("double")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, with both likenesses.

    The edited text has the last third of its code points replaced by as many first ones of the next document (ids
    descending, after the last the first). ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, a row for each id. Null text is empty. Rows repeating an id are one document with the
    smallest of their texts; rows without id cannot be named and have no row. An empty table gives an empty result;
    other columns are ignored.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    if not own.groupBy("id").count().where("count > 1").isEmpty():
        own = own.groupBy("id").agg(F.min("text").alias("text"))
    terms = written(lexicon(own), "lexicon")
    sizes = own.select("id", F.char_length("text").cast("long").alias("n_chars"))
    link = written(next_ids(sizes).join(sizes.select(F.col("id").alias("of"), "n_chars"), F.col("id") == F.col("of")).select("id", "next_id", "n_chars"), "next")
    ahead = link.select(F.col("id").alias("reader"), F.col("next_id").alias("source"), F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    lent = own.join(ahead, F.col("id") == F.col("source")).select("reader", F.col("take"), F.expr("substring(text, 1, take)").alias("lent"))
    both = own.join(lent, F.col("id") == F.col("reader"))
    chars = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - take)"), F.col("lent"))
    both = both.select("id", "text", edited.alias("edited"), chars.cast("string").alias("n_chars"))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.col("n_chars").alias("note")),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("note")),
    )
    texts = both.select("id", F.inline(kinds))
    found = written(fingerprints(texts, terms), "fingerprints")
    plain = found.where("kind = 0").select("id", F.col("marks").alias("a"), F.col("note").cast("long").alias("n_chars"))
    after = found.where("kind = 1").select(F.col("id").alias("id1"), F.col("marks").alias("b"), F.col("note").alias("edited_sha256"))
    other = found.where("kind = 0").select(F.col("id").alias("id2"), F.col("marks").alias("c"))
    rows = plain.join(after, F.col("id") == F.col("id1")).join(link.select(F.col("id").alias("id3"), "next_id"), F.col("id") == F.col("id3")).join(other, F.col("next_id") == F.col("id2"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", F.array_join("a", "").alias("fingerprint"), F.array_join("b", "").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"),
    )
