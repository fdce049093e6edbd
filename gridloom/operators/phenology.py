"""Phenology: turning points of the year from cumulative deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nodes(obs: DataFrame, key: str, day: str, value: str, order: Sequence[str]) -> DataFrame:
    """Days at which the cumulative deviation from the pixel's mean is least (``node2``) and largest (``node4``).

    Observations of all years are taken in the order given; the first and last do not count.
    """
    means = obs.groupBy(key).agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.col(value) - F.col("_m")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = obs.join(means, key).withColumns({"_c": F.round(run, 6), "_i": F.row_number().over(w)}).where("_i > 1 and _i < _n")
    return rows.groupBy(key).agg(F.min_by(day, F.struct("_c", "_i")).alias("node2"), F.max_by(day, F.struct("_c", -F.col("_i"))).alias("node4"))


def _within(day: Column, start: str, end: str) -> Column:
    """Whether a day lies in [start, end), over the year's end if it starts later than it ends."""
    s, e = F.col(start), F.col(end)
    return F.when(s <= e, (day >= s) & (day < e)).otherwise((day >= s) | (day < e))


def cycle(obs: DataFrame, key: str, day: str, value: str, order: Sequence[str]) -> DataFrame:
    """The four turning points of the year and the four segments between them.

    ``node2`` and ``node4`` as in ``nodes``; ``node3`` and ``node1`` are the days of the largest absolute deviation from
    node2 to node4 and from node4 to node2. Of each segment i (node i to the next): ``days_i``, ``median_i``, and
    ``slope_i, offset_i`` of value on day (0 if there is none). ``background`` is the least median, ``amplitude`` the
    largest less the least.
    """
    means = obs.groupBy(key).agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.col(value) - F.col("_m")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = obs.join(means, key).withColumns({"_c": F.round(run, 6), "_i": F.row_number().over(w), "_d": F.col(day)})
    inner = F.col("_i").between(2, F.col("_n") - 1)
    ends = rows.where(inner).groupBy(key).agg(F.min_by("_d", F.struct("_c", "_i")).alias("node2"), F.max_by("_d", F.struct("_c", -F.col("_i"))).alias("node4"))
    halves = rows.where(inner).join(ends, key)
    far = F.struct(F.abs("_c"), -F.col("_i"))
    pick = lambda a, b: F.max_by("_d", F.when(_within(F.col("_d"), a, b), far))
    found = halves.groupBy(key, "node2", "node4").agg(pick("node4", "node2").alias("node1"), pick("node2", "node4").alias("node3"))
    parts = rows.select(key, "_d", F.col(value).alias("_v")).join(found, key)
    sums = []
    for i in range(1, 5):
        inside = _within(F.col("_d"), f"node{i}", f"node{i % 4 + 1}")
        v, d = F.when(inside, F.col("_v")), F.when(inside, F.col("_d")).cast("double")
        sums += [F.median(v).alias(f"median_{i}"), F.coalesce(F.regr_slope(v, d), F.lit(0.0)).alias(f"slope_{i}"), F.coalesce(F.regr_intercept(v, d), F.lit(0.0)).alias(f"offset_{i}")]
    names = [f"node{i}" for i in range(1, 5)]
    out = parts.groupBy(key, *names).agg(*sums)
    length = lambda i: F.col(f"node{i % 4 + 1}") - F.col(f"node{i}")
    out = out.withColumns({f"days_{i}": length(i) + F.when(length(i) < 0, 365).otherwise(0) for i in range(1, 5)})
    medians = [F.col(f"median_{i}") for i in range(1, 5)]
    return out.withColumns({"background": F.least(*medians), "amplitude": F.greatest(*medians) - F.least(*medians)})


def monthly_medians(obs: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """A column ``month_<m>`` for each month: the median over all years; masked without observations."""
    return obs.groupBy(key).agg(*(F.median(F.when(F.month(at) == m, F.col(value))).alias(f"month_{m}") for m in range(1, 13)))
