"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay
code [23, 12, 7]. Every word lies within three bits of exactly one codeword, whose 12-bit message is the word's index.
Two fingerprints at three or fewer differing bits have two segments with at most one differing bit each (pigeonhole:
two segments with two or more would make four). A probe therefore emits, for each pair of segments, the indices of all
words within one bit (one index, or six where the word is three bits from its codeword); the indexed side emits the
index of the word itself. Equal keys are joined, and the exact distance is verified inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_side, written
from .components import connected_components
from .shingles import SHINGLE, SIMILARITY, linked_sets, set_rows

#: Generator polynomial of the binary Golay code, its length and its check bits.
GENERATOR, WORD_BITS, CHECK_BITS = 0xC75, 23, 11
#: Width of the three segments, from the low bits up.
SEGMENTS = (22, 21, 21)
MAX_BITS = 3
#: Fingerprints without any document id get a node number from here on; document ids must be below.
NO_ID = 1 << 62
HASH_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of ``text``: ASCII letters lower-cased, words between ASCII white space, repeats count.

    Fewer words than a shingle are one shingle; no word gives zero. A bit is set if over half the hashes set it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, HASH_CHUNK):
        hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(at, min(n, at + HASH_CHUNK))), "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` for every row: whole texts, null as empty, ``fp`` the unsigned fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 11 and lower 12 bits of a word, and the error of up to three bits of each syndrome."""

    def remainder(word: int) -> int:
        for i in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - CHECK_BITS)
        return word

    low = np.array([remainder(i) for i in range(1 << 12)], np.int64)
    high = np.array([remainder(i << 12) for i in range(1 << 11)], np.int64)
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(WORD_BITS), n):
            word = sum(1 << b for b in bits)
            errors[remainder(word)] = word
    return high, low, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit message of the codeword nearest to each 23-bit word."""
    high, low, errors = _tables()
    return (words ^ errors[high[words >> 12] ^ low[words & 0xFFF]]) >> CHECK_BITS


def golay_indices(words: np.ndarray, width: int) -> list[np.ndarray]:
    """For each word, the distinct indices of all words within one bit of it, among its ``width`` used bits."""
    around = np.stack([words, *(words ^ (1 << i) for i in range(width))], axis=1)
    index = np.sort(golay_index(around), axis=1)
    first = np.concatenate([np.ones((len(words), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
    return [row[keep] for row, keep in zip(index, first, strict=True)]


def segments(fps: np.ndarray) -> list[np.ndarray]:
    out, at, bits = [], 0, fps.astype(np.uint64, copy=False)
    for width in SEGMENTS:
        out.append((bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


def own_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) rows of the indexed side: one key for each pair of segments."""
    index = [golay_index(s) for s in segments(fps)]
    keys = [(p << 24) | (index[i] << 12) | index[j] for p, (i, j) in enumerate(combinations(range(3), 2))]
    return np.tile(np.arange(len(fps)), 3), np.concatenate(keys)


def probe_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) rows of the probing side: every combination of indices within one bit, for each pair."""
    near = [golay_indices(s, w) for s, w in zip(segments(fps), SEGMENTS, strict=True)]
    rows, keys = [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        for at in range(len(fps)):
            made = (((p << 24) | (near[i][at] << 12))[:, None] | near[j][at][None, :]).ravel()
            keys.append(made)
            rows.append(np.full(len(made), at))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *keys])


def _keyed(fps: DataFrame, keys, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 2048):
                part = values[at : at + 2048]
                rows, made = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(made.astype(np.int32)), pa.array(part[rows])], names=["key", name])

    # a written table of fingerprints is a few files; each row becomes up to a hundred keys
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return fps.select("fp").repartition(parts).mapInArrow(run, f"key int, {name} long")


def linked_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: every two distinct fingerprints at ``max_bits`` (3 at most) or fewer differing bits, once.

    ``distinct`` is a written table with a column ``fp``. Candidates never leave the join: the distance is its condition.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the segments' pigeonhole holds for at most three differing bits")
    probe, index = _keyed(distinct, probe_keys, "a"), _keyed(distinct, own_keys, "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return probe.join(index, (probe["key"] == index["key"]) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``(id, fp, component_id)`` for every row: the smallest id reachable over links of ``max_bits`` or fewer bits.

    Equal fingerprints are one node, so copies never become pairs. Null and blank texts have fingerprint zero and link
    like others. A row without id gets its group's smallest id, null if the group has none. Repeated ids keep one row
    each and join their fingerprints' groups. An empty table gives an empty result; other columns are ignored. Ids are
    below 2**62. Texts of any length are read whole, their shingles hashed in chunks.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    spare = F.lit(NO_ID) + F.col("fp").bitwiseAND(F.lit(NO_ID - 1))
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("low")).select("fp", F.coalesce("low", spare).alias("node")), "nodes")
    links = written(linked_fingerprints(nodes, max_bits), "links")
    first = nodes.select(F.col("fp").alias("a"), F.col("node").alias("src"))
    second = nodes.select(F.col("fp").alias("b"), F.col("node").alias("dst"))
    parts = connected_components(links.join(first, "a").join(second, "b").select("src", "dst"))
    groups = written(
        nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component")), "groups"
    )
    found = F.when(F.col("component") < NO_ID, F.col("component"))
    return fps.join(groups, "fp").select("id", "fp", found.alias("component_id"))


def hex16(column) -> F.Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_sets(sets: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(src, dst)``: candidate links of written ``(h, n, fp)``, found by Golay keys; equal fingerprints meet at their first set."""
    fps = sets.where("n > 0").select("h", "fp")
    heads = written(fps.groupBy("fp").agg(F.min("h").alias("head")), "print-heads")
    inside = fps.join(heads, "fp").where("h <> head").select(F.col("head").alias("src"), F.col("h").alias("dst"))
    a, b = heads.toDF("a", "src"), heads.toDF("b", "dst")
    return inside.unionByName(linked_fingerprints(heads, max_bits).join(a, "a").join(b, "b").select("src", "dst"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id; blank texts are a group too.

    Near: that share of their five-word shingles in common, by sets, verified exactly. SimHash with Golay keys finds the near ones among
    candidates first; such similarity lies at five to ten differing bits, beyond any such key, so that lowest hashes of the
    sets complete it: eight of them miss a pair at 0.8 with a chance of 3 in a million. Groups are those of all links.
    Rows without id cannot be named and stay; rows repeating the kept id are that document and stay with it, those
    repeating any id join their groups. Null texts count as blank. An empty table gives an empty result; other columns stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    rows = written(set_rows(named, id_col, text_col, shingle), "shingles")
    sets = written(rows.groupBy("h").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "set-rows")
    ids = rows.select("id", "h").distinct()
    low = ids.groupBy("id").agg(F.min("h").alias("src"), F.count("*").alias("n")).where("n > 1")
    same = ids.join(low, "id").select("src", F.col("h").alias("dst"))
    links = linked_sets(named, sets, similarity, near_sets(sets), id_col, text_col, shingle)
    parts = written(connected_components(links.unionByName(same)), "set-parts")
    placed = ids.join(small_side(parts), ids["h"] == parts["node"], "left").select("id", F.coalesce("component", "h").alias("part"))
    placed = written(placed, "shingle-groups")
    firsts = written(placed.groupBy("part").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("part", "first"), "firsts")
    gone = placed.join(small_side(firsts), "part").where("id <> first").select(F.col("id").alias("gone_id")).distinct()
    gone = written(gone, "gone")
    released(rows, sets, parts, placed, firsts)
    return docs.join(small_side(gone), docs[id_col].cast("long") == gone["gone_id"], "left_anti")
