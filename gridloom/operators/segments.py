"""Segmented time series: lookups by date, values, gaps and breakpoints. Segments are rows (pixel, t_start, t_end, ...)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(segments: DataFrame, dates: DataFrame, key: str, how: str, columns: Sequence[str]) -> DataFrame:
    """For each (key, t) of ``dates``, a segment's columns, masked if there is none.

    ``mask``: the first that covers t; ``previous``: the last that starts by t; ``next``: the first that ends after t;
    ``closest``: the next one if t is nearer to a start than to an end, else the previous one. Joined by key and reduced
    at once: no list of segments is built.
    """
    picked = F.struct(*columns)
    t, start, end = F.col("t"), F.col("t_start"), F.col("t_end")
    previous = F.max_by(picked, F.when(start <= t, start))
    after = F.min_by(picked, F.when(end > t, start))
    picks = {
        "mask": F.min_by(picked, F.when((start <= t) & (t <= end), start)),
        "previous": previous,
        "next": after,
        "closest": F.coalesce(F.when(F.min(F.abs(end - t)) > F.min(F.abs(start - t)), after).otherwise(previous), previous, after),
    }
    return dates.join(segments.select(key, "t_start", "t_end", *(c for c in columns if c not in ("t_start", "t_end"))), key, "left").groupBy(key, "t").agg(picks[how].alias("_s")).select(key, "t", "_s.*")


def at_points(segments: DataFrame, points: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """For each of ``points``, arrays of its segments' ``columns`` (renamed) in order of ``t_start``: missing dates are 0, and points
    without segments have empty arrays. A pixel has a few segments."""
    one = F.struct(F.col("t_start").alias("_at"), *(F.coalesce(F.col(c), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(columns)))
    each = segments.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(one)).alias("_s"))
    rows = points.join(each, F.col(key) == F.col("_k"), "left")
    return rows.select(*points.columns, *(F.coalesce(F.col(f"_s._{i}"), F.array().cast("array<double>")).alias(n) for i, n in enumerate(columns.values())))


def first_last(segments: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    picked = F.struct(*columns)
    return segments.groupBy(key).agg(F.min_by(picked, "t_start").alias("first"), F.max_by(picked, "t_start").alias("last"))


def range_mean(segments: DataFrame, key: str, start: float, end: float, value: Column) -> DataFrame:
    """Mean of a segment value over a range of dates, weighted by the share of the range each segment covers."""
    lo, hi = F.greatest("t_start", F.lit(start)), F.least("t_end", F.lit(end))
    rows = segments.where((F.col("t_start") < end) & (F.col("t_end") > start)).withColumns({"_d": hi - lo, "_v": value})
    return rows.groupBy(key).agg((F.sum(F.col("_v") * F.col("_d")) / F.nullif(F.sum("_d"), F.lit(0.0))).alias("value"))


def breakpoint_of(segments: DataFrame, key: str, start: float, end: float, direction: str = "ANY", least: float = 0.0, pick: str = "FIRST") -> DataFrame:
    """One breakpoint of each pixel in [start, end): by date, magnitude or confidence (magnitude over rmse)."""
    rows = segments.withColumn("confidence", F.abs("magnitude") / F.nullif(F.col("rmse"), F.lit(0.0)))
    rows = rows.where((F.col("t_break") >= start) & (F.col("t_break") < end) & (F.col("confidence") >= least))
    if direction != "ANY":
        rows = rows.where(F.col("magnitude") > 0 if direction == "INCREASE" else F.col("magnitude") < 0)
    best = F.struct("t_break", "magnitude", "confidence")
    picks = {
        "FIRST": F.min_by(best, "t_break"),
        "LAST": F.max_by(best, "t_break"),
        "MAGNITUDE": F.max_by(best, F.struct(F.abs("magnitude"), -F.col("t_break"))),
        "CONFIDENCE": F.max_by(best, F.struct("confidence", -F.col("t_break"))),
    }
    return rows.groupBy(key).agg(picks[pick].alias("_b")).select(key, "_b.*")


def transitions(segments: DataFrame, key: str, keep_last: bool = True) -> DataFrame:
    """Pairs of consecutive segments; ``keep_last=False`` leaves out each pixel's last pair, as some recipes did."""
    w = Window.partitionBy(key).orderBy("t_start")
    rows = segments.withColumns({"to_start": F.lead("t_start").over(w), "_after": F.lead("t_start", 2).over(w)}).where(F.col("to_start").isNotNull())
    rows = rows if keep_last else rows.where(F.col("_after").isNotNull())
    return rows.select(key, F.col("t_start").alias("from_start"), "to_start")


def gaps(segments: DataFrame, key: str, start: float, end: float) -> DataFrame:
    """Intervals of [start, end] that no segment covers: before the first, between segments, after the last."""
    w = Window.partitionBy(key).orderBy("t_start")
    rows = segments.withColumns({"_next": F.lead("t_start").over(w), "_first": F.lag("t_start").over(w).isNull()})
    between = F.struct(F.col("t_end").alias("gap_start"), F.coalesce("_next", F.lit(end)).alias("gap_end"))
    leading = F.struct(F.lit(start).alias("gap_start"), F.col("t_start").alias("gap_end"))
    both = F.when(F.col("_first"), F.array(leading, between)).otherwise(F.array(between))
    return rows.select(key, F.inline(both)).where("gap_end > gap_start")


def fixed_intervals(segments: DataFrame, key: str, step: float) -> DataFrame:
    """Each segment cut at multiples of ``step``."""
    first, last = F.floor(F.col("t_start") / step), F.ceil(F.col("t_end") / step) - 1
    rows = segments.withColumn("interval", F.explode(F.sequence(first, F.greatest(first, last))))
    lo, hi = F.greatest("t_start", F.col("interval") * step), F.least("t_end", (F.col("interval") + 1) * step)
    return rows.select(key, "interval", lo.alias("t_start"), hi.alias("t_end"))


def daily(segments: DataFrame, key: str, value: Column, error: str) -> DataFrame:
    """A row for each whole day inside each segment, with the model's value and band of error."""
    rows = segments.withColumn("t", F.explode(F.sequence(F.ceil("t_start"), F.floor("t_end"))))
    return rows.select(key, "t", value.alias("value"), (value - F.col(error)).alias("low"), (value + F.col(error)).alias("high"))


def value_at(segments: DataFrame, dates: DataFrame, key: str, slope: str, offset: str, most_days: float | None = None) -> DataFrame:
    """``value`` of a line offset + slope * t at each (key, t), with gaps filled.

    Inside a segment its own line; between two, the straight line from the end of one to the start of the next; before
    the first and after the last its line, held at its end (no further than ``most_days`` away, if given).
    """
    columns = ["t_start", "t_end", slope, offset]
    at = dates.select(key, "t").distinct()
    parts = {how: lookup(segments, at, key, how, columns).select(key, "t", *(F.col(c).alias(f"{how}_{c}") for c in columns)) for how in ("previous", "next")}
    rows = parts["previous"].join(parts["next"], [key, "t"])
    t = F.col("t")
    line = lambda how, x: F.col(f"{how}_{offset}") + F.col(f"{how}_{slope}") * x
    end, start = F.col("previous_t_end"), F.col("next_t_start")
    inside = F.col("previous_t_end") >= t
    share = (t - end) / F.nullif(start - end, F.lit(0.0))
    between = line("previous", end) + share * (line("next", start) - line("previous", end))
    near = F.lit(True) if most_days is None else F.coalesce(t - end, start - t) <= most_days
    held = F.when(near, F.coalesce(line("previous", end), line("next", start)))
    return rows.select(key, "t", F.when(inside, line("previous", t)).when(end.isNotNull() & start.isNotNull() & (start > t), between).otherwise(held).alias("value"))


def extreme(segments: DataFrame, key: str, band: str, how: str, columns: Sequence[str]) -> DataFrame:
    """Each pixel's segment of the least or largest value of a band; the earliest of equal ones."""
    at = F.struct(F.col(band) if how == "min" else -F.col(band), "t_start")
    picked = F.min_by(F.struct(*columns), F.when(F.col(band).isNotNull(), at))
    return segments.groupBy(key).agg(picked.alias("_s")).select(key, "_s.*")


def clicked(segments: DataFrame, dates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """For each (key, t), the first segment with t_start <= t < t_end, else the first that ends after t."""
    t = F.col("t")
    inside = F.min_by(F.struct(*columns), F.when((F.col("t_start") <= t) & (t < F.col("t_end")), F.col("t_start")))
    after = F.min_by(F.struct(*columns), F.when(F.col("t_end") > t, F.col("t_start")))
    joined = dates.join(segments.select(key, *{"t_start", "t_end", *columns}), key, "left")
    return joined.groupBy(key, "t").agg(F.coalesce(inside, after).alias("_s")).select(key, "t", "_s.*")


def nearest(segments: DataFrame, dates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """For each (key, t), the segment with the smallest gap to t, the earlier of equally near ones; 0 inside a segment."""
    t = F.col("t")
    gap = F.greatest(F.col("t_start") - t, t - F.col("t_end"), F.lit(0.0))
    joined = dates.join(segments.select(key, *{"t_start", "t_end", *columns}), key, "left").withColumn("_gap", gap)
    best = F.min_by(F.struct(*columns, F.col("_gap").alias("gap")), F.when(F.col("_gap").isNotNull(), F.struct("_gap", "t_start")))
    return joined.groupBy(key, "t").agg(best.alias("_s")).select(key, "t", "_s.*")


def range_slice(segments: DataFrame, key: str, start: float, end: float, mean: Column, rmse: str, count: str) -> DataFrame:
    """``value`` and ``error`` over a range of dates: means weighted by the days that each segment covers of it.

    ``mean`` may use ``lo`` and ``hi``, the ends of the part inside the range. A segment's error is its rmse over the root of its
    observations, of which the part's share counts, one at least.
    """
    lo, hi = F.greatest("t_start", F.lit(start)), F.least("t_end", F.lit(end))
    rows = segments.where((F.col("t_start") < end) & (F.col("t_end") > start)).withColumns({"lo": lo, "hi": hi})
    days = F.col("hi") - F.col("lo")
    share = days / F.nullif(F.col("t_end") - F.col("t_start"), F.lit(0.0))
    error = F.col(rmse) / F.sqrt(F.greatest(F.col(count) * share, F.lit(1.0)))
    whole = F.nullif(F.sum(days), F.lit(0.0))
    return rows.groupBy(key).agg((F.sum(mean * days) / whole).alias("value"), (F.sum(error * days) / whole).alias("error"))


def blended(segments: DataFrame, dates: DataFrame, key: str, coefs: str, harmonics: int) -> DataFrame:
    """``value`` at each (key, t): a segment's own model inside it; between two, the straight line from the end of one
    trend to the start of the next, with their waves blended by nearness; masked outside."""
    from ..functions import harmonics as H

    at = dates.select(key, "t").distinct()
    columns = ["t_start", "t_end", coefs]
    t, start, end = F.col("t"), F.col("t_start"), F.col("t_end")
    picked = F.struct(*columns)
    both = at.join(segments.select(key, *columns), key).groupBy(key, "t").agg(F.max_by(picked, F.when(start <= t, start)).alias("p"), F.min_by(picked, F.when(end > t, start)).alias("n"))
    p, n = F.col("p"), F.col("n")
    trend = lambda s, x: s[coefs][0] + s[coefs][1] * x
    wave = lambda s: H.value(s[coefs], t, harmonics) - trend(s, t)
    w = (t - p["t_end"]) / F.nullif(n["t_start"] - p["t_end"], F.lit(0.0))
    line = trend(p, p["t_end"]) + w * (trend(n, n["t_start"]) - trend(p, p["t_end"]))
    between = line + (1 - w) * wave(p) + w * wave(n)
    return both.select(key, "t", F.when(p["t_end"] >= t, H.value(p[coefs], t, harmonics)).when(p.isNotNull() & n.isNotNull(), between).alias("value"))


def slice_at(segments: DataFrame, dates: DataFrame, key: str, how: str, coefs: str, harmonics: int = 3) -> DataFrame:
    """Bands of a slice through segments at dates: value, rmse, magnitude, confidence of the break, and the segment's dates."""
    from ..functions import harmonics as H

    found = lookup(segments, dates, key, how, ["t_start", "t_end", "t_break", "rmse", "magnitude", coefs])
    sure = F.abs("magnitude") / F.nullif(F.col("rmse"), F.lit(0.0))
    return found.select(key, "t", H.value(F.col(coefs), F.col("t"), harmonics).alias("value"), "rmse", "magnitude", sure.alias("break_confidence"), "t_start", "t_end", "t_break")
