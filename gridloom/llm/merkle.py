"""Merkle manifest of a table: a tree over the rows of each group, and one over the groups' roots.

Superblock reduction: nodes are numbered within their tree, and those whose number divided by fanout^k is equal make a
superblock, which one pandas group collapses by k levels to its root. The roots are the nodes of the next round, until
a tree has one superblock: a trillion rows take four rounds. Proofs come back down: the path of a superblock's root to
the top of all is made first, and each of its nodes puts its own k levels before it. A group is never larger than
fanout^k digests, however large a source is; texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, small_side, written

FANOUT, LEVELS = 16, 3
DIGEST = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = "array<struct<pos: int, size: int>>"


def digest(fields: Sequence[F.Column]) -> F.Column:
    """Digest of a record: each field as its length in bytes, a colon and its value, or a dash if it is null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hash(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(n: int, fanout: int, levels: int) -> int:
    """Levels that a superblock of a tree of ``n`` nodes goes up: to the root if it is the only one."""
    up = 0
    while up < levels and n > 1:
        n, up = -(-n // fanout), up + 1
    return up


def _collapse(nodes: Sequence[str], up: int, fanout: int) -> list[list[str]]:
    """The nodes and what each level makes of them; a last run of one is hashed as any other."""
    out = [list(nodes)]
    for _ in range(up):
        last = out[-1]
        out.append([_hash(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def numbered(df: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``df`` (a written table) with ``idx``, each row's number from 0 within its tree, and ``n``, the tree's size.

    Rows are sorted by range, so that a large tree lies in many partitions; what a partition holds of each tree shifts the
    numbers of those after it. ``tree`` is not null.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [F.asc(tree), *(F.asc_nulls_first(c) for c in order)]
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    at = placed.columns.index(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(at).dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
            if names[codes[0]].as_py() == last:
                place[: starts[1] if len(starts) > 1 else len(codes)] += count
            last, count = names[codes[-1]].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], names=[*b.schema.names, "_place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    rows = written(placed.mapInArrow(run, f"{fields}, `_place` bigint"), "merkle-placed")
    here = rows.groupBy(tree, "_part").agg(F.count("*").alias("_here"))
    every = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_here").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(here.select(tree, "_part", before.alias("_before"), F.sum("_here").over(every).alias("n")), "merkle-starts")
    return rows.join(small_side(starts), [tree, "_part"]).select(*df.columns, (F.col("_before") + F.col("_place")).alias("idx"), "n")


@dataclass
class Forest:
    """Numbered nodes ``(tree, idx, n, digest, ...)``, round by round from the leaves; all are written tables."""

    rounds: list[DataFrame]
    fanout: int
    levels: int

    def roots(self) -> DataFrame:
        """``(tree, digest)`` of every tree: a lone leaf is its own root."""
        found = [r.where("n = 1").select("tree", "digest") for r in self.rounds[:1]]
        block = self.fanout**self.levels
        found += [collapsed(r.where(F.col("n").between(2, block)), self.fanout, self.levels).select("tree", "digest") for r in self.rounds]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out

    def paths(self, tops: DataFrame) -> DataFrame:
        """The leaves with ``proof`` (the siblings' digests, level by level upwards, from left to right) and ``shape`` (a
        node's place and its run's size at each level), and ``tops`` columns of their tree.

        ``tops`` ``(tree, proof, shape, ...)`` holds the way of each tree's root on to the top of all.
        """
        block = self.fanout**self.levels
        extra = [c for c in tops.columns if c not in ("tree", "proof", "shape")]
        above = None
        for k in range(len(self.rounds) - 1, -1, -1):
            nodes = self.rounds[k]
            ends = tops.join(nodes.where(F.col("n") <= block).select("tree").distinct(), "tree", "left_semi").select(F.lit(0).cast("long").alias("block"), *tops.columns)
            above = ends if above is None else ends.unionByName(above.select(F.col("idx").alias("block"), *tops.columns))
            above = _extended(nodes, above, extra, self.fanout, self.levels)
            if k:
                above = written(above, "merkle-paths")
        return above


def collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``(tree, idx, n, digest)`` of the next round: superblocks of ``nodes`` collapsed to their roots."""
    size = fanout**levels

    def collapse(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree, n, block = key
        root = _collapse(group.sort_values("idx")["digest"].tolist(), _levels(n, fanout, levels), fanout)[-1][0]
        return pd.DataFrame({"tree": [tree], "idx": [block], "n": [-(-n // size)], "digest": [root]})

    rows = nodes.select("tree", "n", F.expr(f"idx div {size}").alias("block"), "idx", "digest")
    return rows.groupBy("tree", "n", "block").applyInPandas(collapse, "tree string, idx bigint, n bigint, digest string")


def _extended(nodes: DataFrame, above: DataFrame, extra: Sequence[str], fanout: int, levels: int) -> DataFrame:
    """``nodes`` with their own levels put before the path of their superblock, of which ``above`` has one row each."""
    size = fanout**levels
    kept = nodes.schema.fields
    more = [f for f in above.schema.fields if f.name in extra]

    def extend(group: pa.Table, path: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        tail, steps = path["proof"][0].as_py(), [(s["pos"], s["size"]) for s in path["shape"][0].as_py()]
        rows = _collapse(group["digest"].to_pylist(), _levels(group["n"][0].as_py(), fanout, levels), fanout)
        proofs, shapes = [], []
        for i in range(len(group)):
            parts, shape = [], []
            for level in rows[:-1]:
                start = i // fanout * fanout
                run = level[start : start + fanout]
                parts += run[: i - start] + run[i - start + 1 :]
                shape.append((i - start, len(run)))
                i //= fanout
            proofs.append("".join(parts) + tail)
            shapes.append([{"pos": p, "size": s} for p, s in shape + steps])
        own = pa.list_(pa.struct([("pos", pa.int32()), ("size", pa.int32())]))
        columns = [*(group[f.name] for f in kept), pa.array(proofs, pa.string()), pa.array(shapes, own), *(pa.array(path[f.name].to_pylist() * len(group), path[f.name].type) for f in more)]
        return pa.table(columns, names=[*(f.name for f in kept), "proof", "shape", *(f.name for f in more)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "proof string", f"shape {SHAPE}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in more)])
    left = nodes.withColumn("block", F.expr(f"idx div {size}")).groupBy("tree", "block")
    return left.cogroup(above.groupBy("tree", "block")).applyInArrow(extend, schema)


def forest(leaves: DataFrame, order: Sequence[str], fanout: int = FANOUT, levels: int = LEVELS) -> Forest:
    """Trees over ``leaves`` (a written table with ``tree`` and ``digest``), whose leaves ascend by ``order``, nulls first."""
    rounds = [written(numbered(leaves, "tree", order), "merkle-leaves")]
    most = rounds[0].agg(F.max("n").alias("n")).first()["n"] or 0
    size = fanout**levels
    while most > size:
        rounds.append(written(collapsed(rounds[-1].where(F.col("n") > size), fanout, levels), "merkle-round"))
        most = -(-most // size)
    return Forest(rounds, fanout, levels)


def manifest(records: DataFrame, group_col: str, id_col: str, digests: DataFrame | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Each row's ``leaf``, the ``subroot`` of its group, the ``root`` of all, its ``proof`` and the ``shape`` of that.

    ``records`` has ``group_col``, ``id_col``, ``leaf`` (a digest, as ``digest`` makes it) and columns to keep. Leaves of a
    group ascend by id, those without id first; rows that repeat an id are ordered by their digests, and equal rows are
    leaves of their own. The group of null comes first, the others by their UTF-8 bytes. A group of one row has its leaf as
    subroot, and the only group's subroot is the root; proofs may then be empty. An empty table gives an empty result.
    Names of kept columns that are made here (``tree``, ``idx``, ``n``, ``digest``, ``proof``, ``shape``, ``subroot``,
    ``root``) must not occur in ``records``: select and rename them before.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("-"))
    leaves = written(records.withColumn("tree", tree).withColumnRenamed("leaf", "digest"), "merkle-records")
    groups = forest(leaves, [id_col, "digest"], fanout, levels)
    subroots = written(groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-subroots")
    top = forest(subroots, ["name"], fanout, levels)
    root = written(top.roots().select("tree", F.lit("").alias("proof"), F.array().cast(SHAPE).alias("shape"), F.col("digest").alias("root")), "merkle-root")
    tops = written(top.paths(root).select(F.col("name").alias("tree"), "proof", "shape", F.col("digest").alias("subroot"), "root"), "merkle-tops")
    released(leaves, subroots)
    kept = [c for c in records.columns if c != "leaf"]
    return groups.paths(tops).select(*kept, F.col("digest").alias("leaf"), "subroot", "root", "proof", "shape")


def folded(leaf: F.Column, proof: str = "proof", shape: str = "shape") -> F.Column:
    """The root that a leaf and its proof give: equal to the manifest's root exactly if the leaf is the one it was made of."""
    start = F.struct(leaf.alias("node"), F.lit(1).alias("at"))

    def step(state: F.Column, level: F.Column) -> F.Column:
        left, right = level["pos"] * DIGEST, (level["size"] - level["pos"] - 1) * DIGEST
        siblings = lambda at, n: F.substring(proof, at, n)
        node = F.sha2(F.concat(siblings(state["at"], left), state["node"], siblings(state["at"] + left, right)), 256)
        return F.struct(node.alias("node"), (state["at"] + left + right).alias("at"))

    return F.aggregate(shape, start, step)["node"]


def document_records(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, leaf, tampered)`` of documents: ``tampered`` is the leaf of a text with lower-cased A-Z where 5 divides
    the CRC-32 of the id, null elsewhere. Any column may be null (a dash in the record); other columns do not count."""
    own = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")]
    other = digest([*own[:-1], F.translate("text", UPPER, LOWER)])
    return docs.select("doc_id", "source", digest(own).alias("leaf"), F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, other).alias("tampered"))


def audited(records: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``records`` with the root that each row's tampered leaf (its own, where that is null) folds to, and
    whether it is the manifest's."""
    out = manifest(records, "source", "doc_id", fanout=fanout, levels=levels)
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
