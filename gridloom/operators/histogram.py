"""Histograms that adapt to their data: at most so many buckets, widths that are powers of two, exact counts and means.

Buckets start at multiples of their width, so that histograms of parts merge: a wider bucket is made of whole narrower ones. Two
passes, each with map-side sums; nothing but the buckets meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def adaptive(df: DataFrame, value: str, keys: Sequence[str] = (), most: int = BUCKETS) -> DataFrame:
    """``(keys, start, width, n, mean)``: the buckets that hold values, as narrow as ``most`` of them per key allow.

    Masked and infinite values do not count; of a single distinct value the width is 0. Keys without values have no row.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, v.alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    width = F.pow(F.lit(2.0), F.ceil(F.log2((F.col("_b") - F.col("_a")) / most)))
    # aligned buckets may be one too many
    over = F.floor(F.col("_b") / F.col("_w")) - F.floor(F.col("_a") / F.col("_w")) + 1 > most
    ends = ends.withColumn("_w", F.when(F.col("_b") > F.col("_a"), width).otherwise(0.0))
    ends = ends.withColumn("width", F.when((F.col("_w") > 0) & over, F.col("_w") * 2).otherwise(F.col("_w"))).select(*keys, "width")
    both = rows.join(ends, list(keys)) if keys else rows.join(F.broadcast(ends), how="cross")  # one row
    start = F.when(F.col("width") > 0, F.floor(F.col("_v") / F.col("width")) * F.col("width")).otherwise(F.col("_v"))
    return both.groupBy(*keys, start.alias("start"), "width").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))


def merged(histogram: DataFrame, keys: Sequence[str] = (), most: int = BUCKETS) -> DataFrame:
    """One histogram of several of the same keys (their union), as wide as the widest of them and as ``most`` demand."""
    ends = histogram.groupBy(*keys).agg(F.max("width").alias("_w"), F.min("start").alias("_a"), F.max(F.col("start")).alias("_b"))
    least = F.pow(F.lit(2.0), F.ceil(F.log2((F.col("_b") - F.col("_a")) / most)))
    ends = ends.withColumn("_w", F.when(F.col("_b") > F.col("_a"), F.greatest("_w", least)).otherwise(F.col("_w")))
    over = F.floor(F.col("_b") / F.col("_w")) - F.floor(F.col("_a") / F.col("_w")) + 1 > most
    ends = ends.select(*keys, F.when((F.col("_w") > 0) & over, F.col("_w") * 2).otherwise(F.col("_w")).alias("_width"))
    both = histogram.join(ends, list(keys)) if keys else histogram.join(F.broadcast(ends), how="cross")  # one row
    start = F.when(F.col("_width") > 0, F.floor(F.col("start") / F.col("_width")) * F.col("_width")).otherwise(F.col("start"))
    out = both.groupBy(*keys, start.alias("start"), F.col("_width").alias("width")).agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
    return out.select(*keys, "start", "width", "n", "mean")


def cumulative(histogram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """With ``below``, the share of values under the bucket's start, and ``share``, that in the bucket. At most BUCKETS rows a key."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(w)
    return histogram.withColumns({"below": before / total, "share": F.col("n") / total})


def quantiles(histogram: DataFrame, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, share, value)``: evenly inside the bucket that holds the share, so that the rank is off by its count at most."""
    own = cumulative(histogram, keys).withColumn("q", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    inside = (F.col("q") >= F.col("below")) & ((F.col("q") < F.col("below") + F.col("share")) | (F.col("below") + F.col("share") >= 1 - 1e-12))
    part = F.least((F.col("q") - F.col("below")) / F.col("share"), F.lit(1.0))
    found = F.min_by(F.col("start") + part * F.col("width"), F.struct("start"))
    return own.where(inside).groupBy(*keys, "q").agg(found.alias("value")).withColumnRenamed("q", "share")


def matched(df: DataFrame, value: str, source: DataFrame, target: DataFrame, name: str = "matched") -> DataFrame:
    """``df`` with ``value`` moved to where the ``target`` histogram has the share that it has in the ``source`` one.

    Values beyond a histogram's ends move as the nearest end does; masked ones stay masked, and all are if a histogram is empty. Both
    histograms are broadcast, as one row of two arrays of at most BUCKETS buckets each.
    """
    each = lambda h, n: cumulative(h).agg(F.array_sort(F.collect_list(F.struct("start", "width", "below", "share"))).alias(n))
    both = each(source, "_first").join(each(target, "_last"), how="cross")  # one row each
    rows = df.join(F.broadcast(both), how="cross").withColumn("_v", F.col(value).cast("double"))
    at = lambda array, test: F.coalesce(F.try_element_at(F.filter(array, test), F.lit(-1)), F.get(array, 0))
    rows = rows.withColumn("_own", at(F.col("_first"), lambda b: b["start"] <= F.col("_v")))
    own = F.col("_own")
    part = F.when(own["width"] > 0, F.least(F.greatest((F.col("_v") - own["start"]) / own["width"], F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    rows = rows.withColumn("_q", own["below"] + part * own["share"]).withColumn("_other", at(F.col("_last"), lambda b: b["below"] <= F.col("_q")))
    other = F.col("_other")
    moved = other["start"] + F.least((F.col("_q") - other["below"]) / other["share"], F.lit(1.0)) * other["width"]
    return rows.select(*df.columns, F.when(F.col("_v").isNotNull(), moved).alias(name))
