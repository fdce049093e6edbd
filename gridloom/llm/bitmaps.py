"""What each filter of a chain removes, in every order of the chain, from one packed bitmap index.

Each partition packs, for every part of the corpus, one bit a row and filter and one a row and label. For every set of
filters that may come before (a prefix, in whatever order), the rows that are still there are the AND of the negated
filters; the counts of what a further filter removes are popcounts of ANDs with it. Counts of partitions are summed;
orders are read off the sums, since what a filter removes depends on the set before it alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, written

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: Rows to a packed index, and parts whose sums a task holds before it sends them on.
ROWS, PARTS = 1 << 16, 4096
COUNTS = ("alive", "removed", "good", "toxic")


def text_flags(text: F.Column) -> dict[str, F.Column]:
    """Failure conditions of a text (null: empty): few words, repeated words, capitals, odd characters."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        "C": F.lit(100) * capitals > F.lit(3) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _packed(flags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of ``flags`` (columns x rows, rows in order of part), each part from a byte of its own on: the bytes, and where parts start.

    A part's own bitmap is so the run of its bytes; the bits that fill its last byte are those of no row.
    """
    sizes = np.diff(np.r_[starts, flags.shape[1]])
    room = -(-sizes // 8) * 8
    at = np.r_[0, np.cumsum(room)]
    wide = np.zeros((flags.shape[0] + 1, at[-1]), bool)
    cells = np.repeat(at[:-1] - starts, sizes) + np.arange(flags.shape[1])
    wide[:-1, cells], wide[-1, cells] = flags, True  # the last column tells rows from filling
    return np.packbits(wide, axis=1), at[:-1] // 8


def prefix_counts(flags: np.ndarray, labels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(parts x prefix sets x filters x COUNTS, and one more filter place for rows that fail it alone).

    ``flags`` is filters x rows, ``labels`` good and toxic x rows; rows are in order of part, ``starts`` tells where each begins.
    """
    k = len(flags)
    bits, at = _packed(np.concatenate([flags, labels]), starts)
    filters, good, toxic, rows = bits[:k], bits[k], bits[k + 1], bits[-1]
    popcount = lambda x: np.add.reduceat(np.bitwise_count(x), at, dtype=np.int64)
    out = np.zeros((len(starts), 1 << k, k, len(COUNTS)), np.int64)
    left = [rows]
    for s in range(1, 1 << k):
        f = s.bit_length() - 1
        left.append(left[s ^ (1 << f)] & ~filters[f])
    for s in range(1 << k):
        alive = popcount(left[s])
        for f in range(k):
            if not s >> f & 1:
                gone = left[s] & filters[f]
                out[:, s, f] = np.stack([alive, popcount(gone), popcount(gone & good), popcount(gone & toxic)], axis=1)
    return out


def counted(rows: DataFrame, filters: Sequence[str] = tuple(FILTERS)) -> DataFrame:
    """``(part, prefix, filter, alive, removed, good, toxic)`` summed over all ``rows`` ``(part, <filters>, good, toxic)``.

    ``prefix`` is the set of filters before, bit by bit; ``filter`` is none of them.
    """
    k = len(filters)
    names = [*filters, "good", "toxic"]
    ways = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    prefix, which = pa.array([s for s, _ in ways], pa.int32()), [filters[f] for _, f in ways]

    def send(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, counts in sums.items():
            found = counts[[s for s, _ in ways], [f for _, f in ways]]
            columns = [pa.array([part] * len(ways), pa.string()), prefix, pa.array(which, pa.string()), *(pa.array(found[:, i], pa.int64()) for i in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "prefix", "filter", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                coded = b.column("part").dictionary_encode()
                codes = coded.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
                bits = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(bool)[order] for c in names])
                counts = prefix_counts(bits[:k], bits[k:], starts)
                for code, found in zip(codes[order][starts].tolist(), counts, strict=True):
                    part = coded.dictionary[code].as_py()
                    sums[part] = sums[part] + found if part in sums else found
                if len(sums) > PARTS:
                    yield from send(sums)
                    sums = {}
        yield from send(sums)

    found = rows.select("part", *names).mapInArrow(run, f"part string, prefix int, filter string, {', '.join(f'{c} bigint' for c in COUNTS)}")
    return found.groupBy("part", "prefix", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def chain_orders(spark: SparkSession, filters: Sequence[str] = tuple(FILTERS)) -> DataFrame:
    """``(filter_order, step, filter, prefix)``: every step of every order, with the set of filters before it."""
    rows = []
    for order in permutations(filters):
        prefix = 0
        for i, f in enumerate(order):
            rows.append(("".join(order), i + 1, f, prefix))
            prefix |= 1 << filters.index(f)
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, prefix int")


def interactions(rows: DataFrame, filters: Sequence[str] = tuple(FILTERS)) -> DataFrame:
    """A row for each part, order of the filters and step of the order: what stays, goes, is redundant, unique or lost there.

    ``rows`` ``(part, <filters>, good, toxic)`` holds a boolean for each filter (true: it fails) and label, none null.
    ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` are counts within the part; parts without
    rows have none, and an empty table gives an empty result.
    """
    k = len(filters)
    sums = written(counted(rows, filters), "filter-sums")
    bit = F.element_at(F.create_map(*(x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i)))), F.col("filter"))
    # a set of s filters comes before a filter in s! (k - 1 - s)! orders
    times = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), F.bit_count("prefix") + 1)
    of_filter = Window.partitionBy("part", "filter")
    sums = sums.withColumns({
        "fails": F.max(F.when(F.col("prefix") == 0, F.col("removed"))).over(of_filter),
        "unique_fails": F.max(F.when(F.col("prefix") == F.lit((1 << k) - 1).bitwiseXOR(bit), F.col("removed"))).over(of_filter),
        "shapley": F.sum(F.col("removed") * times).over(of_filter),
    })
    out = sums.join(F.broadcast(chain_orders(rows.sparkSession, filters)), ["filter", "prefix"])  # k! k rows
    return out.select(
        "part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def audited_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, A..E, good, toxic)`` of every document: its language (null: empty), the five filters and its labels.

    E holds where a row of smaller id has the same text; rows without id and those repeating an id that is the smallest do not
    fail it. Null text is empty, and so equal to other empty ones. A document without labels, or with null ones, has neither;
    of repeated labels any 1 counts. Other columns do not count.
    """
    text = F.coalesce("text", F.lit(""))
    flags = [c.alias(f) for f, c in text_flags(F.col("text")).items()]
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), *flags)
    own = written(own, "filter-rows")
    first = own.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1 and first is not null").select("h", "first")
    first = written(first, "first-copies")
    marks = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("id"))
    marks = written(marks.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic")))), "labelled")
    rows = own.join(small_side(first), "h", "left").join(small_side(marks), "id", "left")
    no = F.lit(False)
    return rows.select("part", *"ABCD", F.coalesce(F.col("id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
