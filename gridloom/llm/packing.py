"""Packing token pieces into sequences by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The covering program (fewest sequences such that every
length's count is covered) is solved by multiplicative weights: lengths covered less weigh more, and a knapsack dynamic
program prices the best configuration of each round, whose amount is rounded down to whole sequences; what rounding leaves is priced
anew. All of this works on the histogram, whose size is the capacity: the driver's work does not grow with the number of
documents. Pieces then find their places by joins: a piece's rank among those of its length names its configuration, its
sequence and its offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written
from .tokens import default_path, encoder

CAPACITY = 1024
END_ID = 2
#: Rounds of multiplicative weights that the share of a round is chosen for, how fast weights fall with coverage, and how much
#: more a token of the longest pieces weighs: of configurations that fill a sequence, those of long pieces come first.
ROUNDS, STEP, LONGER = 1000, 0.1, 0.1
#: Pieces that are sent on at once.
SLICE = 2048
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """A row for each piece: a document's ids and the end id, cut only if longer than ``capacity``.

    All pieces of a cut document are ``capacity`` long but the first, which may be shorter. Null text is empty: one
    piece of the end id. ``ids_crc32`` is of the ids as little-endian unsigned 32-bit numbers.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.array([*encode.ids(text.as_py()), end_id], "<u4")
                end, piece, start = (len(ids) - 1) % capacity + 1, 0, 0
                while start < len(ids):
                    rows.append((doc.as_py(), piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + capacity, piece + 1
                if len(rows) >= SLICE:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


def best_configuration(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[Counter, float]:
    """The multiset of lengths within ``capacity``, no length more often than its count, of the largest total value.

    A knapsack dynamic program; counts are split into powers of two, so that each part is taken whole or not.
    """
    best, parts = np.zeros(capacity + 1), []
    for value, length, count in zip(values.tolist(), lengths.tolist(), counts.tolist(), strict=True):
        left, many = min(count, capacity // length), 1
        while left > 0:
            many = min(many, left)
            size = many * length
            with_it = best[: capacity + 1 - size] + many * value
            took = with_it > best[size:]
            best[size:] = np.where(took, with_it, best[size:])
            parts.append((length, many, size, took))
            left, many = left - many, many * 2
    out, room = Counter(), capacity
    for length, many, size, took in reversed(parts):
        if room >= size and took[room - size]:
            out[length] += many
            room -= size
    return out, float(best[capacity])


def lower_bound(histogram: dict[int, int], weights: dict[int, float], capacity: int) -> float:
    """Sequences that any packing needs: the value of ``weights`` as a dual solution of the configuration program."""
    lengths = np.array(sorted(histogram), np.int64)
    values, counts = np.array([weights[n] for n in lengths.tolist()]), np.array([histogram[n] for n in lengths.tolist()])
    return float(values @ counts) / best_configuration(values, lengths, counts, capacity)[1]


def priced_plan(histogram: dict[int, int], capacity: int, most: int = ROUNDS) -> tuple[list[tuple[Counter, int]], float]:
    """(configuration, number of sequences) that hold the histogram, by multiplicative weights, and a lower bound of sequences.

    Each round weighs a length by its tokens times a factor that falls exponentially with the share of it that is covered,
    and prices the best configuration of what is left. Its amount is a share of what its scarcest length has left, rounded
    down to whole sequences but one at least; the residual is priced anew, until nothing is left. The share grows with the
    number of lengths, so that rounds stay near ``most`` whatever the counts. Where the weights' best configuration leaves room, the one of
    most tokens is taken if it leaves less. The bound is the volume's, or the weights' of every 256th round as dual solutions.
    """
    lengths = np.array(sorted(n for n in histogram if n < capacity), np.int64)[::-1]
    total = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    left, out, done = total.copy(), [], 0
    if histogram.get(capacity):
        out.append((Counter({capacity: 1}), histogram[capacity]))
    place = {n: i for i, n in enumerate(lengths.tolist())}
    whole = sum(n * c for n, c in histogram.items()) / capacity
    tokens, bound, share = lengths * (1 + LONGER * lengths / capacity), whole, min(1.0, len(lengths) / most)
    while left.any():
        covered, open_ = 1 - left / np.maximum(total, 1), np.flatnonzero(left)
        weights = tokens * np.exp(np.clip((covered[open_].min() - covered) / STEP, -600, 0))
        config, _ = best_configuration(weights[open_], lengths[open_], left[open_], capacity)
        used = sum(n * times for n, times in config.items())
        if used < capacity:
            other, _ = best_configuration(tokens[open_], lengths[open_], left[open_], capacity)
            config = other if sum(n * times for n, times in other.items()) > used else config
        if done % 256 == 255:
            dual = dict(zip(lengths.tolist(), weights.tolist(), strict=True)) | ({capacity: float(weights.max())} if histogram.get(capacity) else {})
            bound = max(bound, lower_bound(histogram, dual, capacity))
        at = np.array([place[n] for n in config])
        times = np.array(list(config.values()), np.int64)
        n = max(1, int(share * (left[at] // times).min()))
        left[at] -= n * times
        out.append((config, n))
        done += 1
    return out, bound


def fill(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing over runs of equal lengths: (configuration, number of sequences)."""
    spaces: list[int] = []
    bins: dict[int, list[tuple[Counter, int]]] = {}

    def put(space: int, config: Counter, n: int) -> None:
        if space not in bins:
            bins[space] = []
            insort(spaces, space)
        bins[space].append((config, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, Counter({length: each}), left // each)
                if left % each:
                    put(capacity - left % each * length, Counter({length: left % each}), 1)
                break
            space = spaces[i]
            config, n = bins[space].pop()
            if not bins[space]:
                del bins[space], spaces[i]
            each = min(space // length, left)
            take = min(n, left // each)
            put(space - each * length, config + Counter({length: each}), take)
            if n > take:
                put(space, config, n - take)
            left -= take * each
    return [x for kind in bins.values() for x in kind]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """(configuration, number of sequences) that hold exactly the histogram's pieces: priced configurations, or best-fit
    decreasing where that needs fewer sequences."""
    if not histogram:
        return []
    priced, plain = priced_plan(histogram, capacity)[0], fill(histogram, capacity)
    return min(priced, plain, key=lambda p: sum(n for _, n in p))


def slots(planned: list[tuple[Counter, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces to a sequence, first sequence, offset of the first piece) of each run."""
    out, ranks, sequence = [], Counter(), 0
    for config, n in planned:
        offset = 0
        for length in sorted(config, reverse=True):
            out.append((length, ranks[length], n * config[length], config[length], sequence, offset))
            ranks[length] += n * config[length]
            offset += length * config[length]
        sequence += n
    return out


def ranked(cut: DataFrame, shards: int) -> DataFrame:
    """``cut`` with ``rank``, from 0 among the pieces of equal length, made from counts by shard: no length is one task."""
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int")
    dealt = cut.withColumn("shard", shard)
    counts = written(dealt.groupBy("length", "shard").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "starts")
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    local = dealt.withColumn("local", F.row_number().over(inside) - 1)
    return local.join(small_side(starts), ["length", "shard"]).withColumn("rank", F.col("base") + F.col("local")).drop("shard", "base", "local")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row.

    Offsets in a sequence run from 0 without gaps. Null text packs as empty; repeated rows and null ids are packed like
    any other row, each of them once; an empty table gives an empty result; other columns are ignored. A text of any
    length is encoded whole and cut into pieces. Equal lengths take their places by id, piece and checksum.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, capacity, end_id, path), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows = slots(plan(histogram, capacity))
    kinds = "length long, first long, ranks long, each long, base long, place long"
    runs = spark.createDataFrame(rows, kinds) if rows else spark.createDataFrame([], kinds)
    # one run holds consecutive ranks of a length: the last run starting at or before a rank is found in an array
    starts = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "each", "base", "place"))).alias("runs"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = ranked(cut, shards).join(F.broadcast(starts), "length")
    run = F.expr("runs[int(aggregate(runs, -1L, (n, r) -> if(r.first <= rank, n + 1, n)))]")
    placed = placed.withColumn("run", run).withColumn("at", F.col("rank") - F.col("run.first"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.base") + F.floor(F.col("at") / F.col("run.each"))).alias("sequence_id"),
        (F.col("run.place") + F.col("at") % F.col("run.each") * F.col("length")).cast("long").alias("offset"),
    )
