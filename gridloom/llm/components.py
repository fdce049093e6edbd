"""Connected components of an edge table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_side, written


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(src, dst)`` long pairs to ``(node, component)``, the component being its smallest node.

    Rounds of hooking and contraction: every node points to its smallest neighbour (a map-side minimum), pointers are
    doubled until they reach their roots, and the links become links between roots, repeated and inner ones gone. A hub
    is gone after one round, and what is left at least halves. Labels are looked up by broadcast where they are few,
    otherwise by a shuffle on the node. Self links and nulls are dropped, repeated links count once, an empty table
    gives an empty result.
    """
    pairs = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    left = written(pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    found = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        ends = left.select("src", "dst").unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = ends.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("root"))
        roots = _to_roots(written(near, "roots"), max_rounds)
        if found is None:
            found = roots
        else:
            moved = roots.toDF("old", "new")
            found = written(found.join(small_side(moved), F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        a, b = small_side(roots).toDF("na", "ra"), small_side(roots).toDF("nb", "rb")
        up = left.join(a, F.col("src") == F.col("na")).join(b, F.col("dst") == F.col("nb")).where("ra <> rb")
        after = written(up.select(F.greatest("ra", "rb").alias("src"), F.least("ra", "rb").alias("dst")).distinct(), "edges")
        released(left)
        left = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if found is None:
        found = left.toDF("node", "root")
    return found.select("node", F.col("root").alias("component"))


def _to_roots(roots: DataFrame, max_rounds: int) -> DataFrame:
    """``(node, root)`` with each pointer followed to its end: pointers always lead to smaller nodes."""
    for _ in range(max_rounds):
        # only what still moves: nodes that others point to and that point further
        further = written(roots.where("root <> node").toDF("at", "next").join(roots.select(F.col("root").alias("at")).distinct(), "at", "left_semi"), "further")
        if further.isEmpty():
            return roots
        after = written(roots.join(small_side(further), F.col("root") == F.col("at"), "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        released(roots, further)
        roots = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
