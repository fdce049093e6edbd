"""Histogram matching and scenes over a grid of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def percentiles(df: DataFrame, value: str, shares: Sequence[float], name: str) -> DataFrame:
    """One row of one array, null without values: the exact percentiles of ``value`` at ``shares``, straight between two ranks.

    Values are counted, parted by range and numbered in their parts; a part's rows before it are a sum of a row a part. Only the
    values at the wanted ranks meet in one place.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    counts = df.select(F.col(value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    parts = staged(counts.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id()), "value-counts")
    sizes = parts.groupBy("part").agg(F.sum("n").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    to = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    spans = parts.join(F.broadcast(starts), "part").withColumn("to", to).withColumn("from", F.col("to") - F.col("n"))
    held = lambda r: (F.col("from") <= r) & (r < F.col("to"))
    places = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("all") - 1) * F.lit(float(q))).alias("at")) for i, q in enumerate(shares)))
    wanted = F.explode(F.filter(places, lambda k: held(F.floor(k["at"])) | held(F.ceil(k["at"])))).alias("k")
    low, high = F.floor("k.at"), F.ceil("k.at")
    ends = spans.select("v", "from", "to", wanted).groupBy("k.i", "k.at").agg(F.max(F.when(held(low), F.col("v"))).alias("a"), F.max(F.when(held(high), F.col("v"))).alias("b"))
    between = (F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")
    found = ends.select("i", F.when((F.floor("at") == F.ceil("at")) | (F.col("a") == F.col("b")), F.col("a")).otherwise(between).alias("v"))
    every = F.array_sort(F.collect_list(F.struct("i", "v")))
    return found.agg(F.when(F.count("*") > 0, F.transform(every, lambda x: x["v"])).alias(name))


def matched(source: DataFrame, target: DataFrame, value: str, knots: int = 100) -> DataFrame:
    """``source`` with ``matched``: each value moved to the target's value of the same quantile.

    Quantiles of both sides are taken at ``knots`` + 1 places, with straight lines between; both tables of knots are one
    row. Values beyond the knots get the end values; masked values stay masked.
    """
    shares = [i / knots for i in range(knots + 1)]
    row = lambda df, name: percentiles(df, value, shares, name)
    both = source.crossJoin(F.broadcast(row(source, "_s").crossJoin(row(target, "_t"))))
    below = F.size(F.filter("_s", lambda x: x <= F.col(value)))
    at = F.least(F.greatest(below - 1, F.lit(0)), F.lit(knots - 1))
    rows = both.withColumn("_i", at)
    s0, s1, t0, t1 = (F.get(F.col(c), F.col("_i") + k) for c in ("_s", "_t") for k in (0, 1))
    share = F.least(F.greatest(F.coalesce((F.col(value) - s0) / F.nullif(s1 - s0, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("matched", F.when(F.col(value).isNotNull(), t0 + share * (t1 - t0))).drop("_s", "_t", "_i")


def scene_cells(scenes: DataFrame, size: float, key: str = "scene") -> DataFrame:
    """``(key, cx, cy, inside)``: grid cells that each scene's box (x0, y0, x1, y1) meets, and whether it holds the cell's centre.

    Each scene makes its own cells, so that no scene is compared with cells it cannot meet.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    rows = scenes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    mid = lambda c: (F.col(c) + 0.5) * size
    inside = mid("cx").between(F.col("x0"), F.col("x1")) & mid("cy").between(F.col("y0"), F.col("y1"))
    return rows.select(key, "cx", "cy", inside.alias("inside"))


def in_polygon(x, y, corners: list[tuple[float, float]]):
    """Whether a point lies in a polygon: the number of its sides to the right is odd. A handful of corners, one expression."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        if ay == by:
            continue
        crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        odd = odd != crosses
    return odd


def box_union(df: DataFrame, key: str) -> DataFrame:
    """Each key's smallest box around its boxes."""
    return df.groupBy(key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def box_intersection(df: DataFrame, key: str) -> DataFrame:
    """The box common to each key's boxes; masked if there is none."""
    box = df.groupBy(key).agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    some = (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    return box.select(key, *(F.when(some, F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")))
