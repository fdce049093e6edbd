"""Slices through fitted segments: every band of a pixel's segments at a date or over a range of dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import harmonics as H

UNITS = {0: "day", 1: "year", 2: "millisecond"}
#: Length of a day in each date format.
DAYS = {0: 1.0, 1: 1 / 365.25, 2: 86_400_000.0}


def beside(segments: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """``(key, t, previous, next)``: the segment that starts last by t, and the first one that ends after t.

    One sorted pass over segments and dates together; what lies between a pixel's dates and segments is never multiplied.
    Dates of pixels without segments have nulls. Of segments that start (end) together the last (first) row in order of the
    other date counts.
    """
    own = [c for c in segments.columns if c != key]
    kind = F.struct(*(F.col(c) for c in own))
    at = dates.select(key, "t").distinct()
    none = F.lit(None).cast(segments.select(kind.alias("s")).schema[0].dataType)
    by_start = segments.select(key, F.col("t_start").cast("double").alias("_at"), F.lit(0).alias("_date"), kind.alias("_s"))
    by_end = segments.select(key, F.col("t_end").cast("double").alias("_at"), F.lit(0).alias("_date"), kind.alias("_s"))
    asked = at.select(key, F.col("t").cast("double").alias("_at"), F.lit(1).alias("_date"), none.alias("_s"))
    back = Window.partitionBy(key).orderBy("_at", "_date", F.col("_s.t_end")).rowsBetween(Window.unboundedPreceding, 0)
    # ends at t itself are past: they come first when looking ahead from the back
    ahead = Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("_date"), F.desc("_s.t_start")).rowsBetween(Window.unboundedPreceding, 0)
    previous = by_start.unionByName(asked).withColumn("previous", F.last("_s", True).over(back)).where("_date = 1")
    following = by_end.unionByName(asked.withColumn("_date", F.lit(-1))).withColumn("next", F.last("_s", True).over(ahead)).where("_date = -1")
    return previous.select(key, F.col("_at").alias("t"), "previous").join(following.select(key, F.col("_at").alias("t"), "next"), [key, "t"])


def _bands(s: Column, band: str, t: Column, waves: int, unit: str) -> dict[str, Column]:
    c = s[f"{band}_coefs"]
    out = {band: H.value(c, t, waves, unit), f"{band}_intercept": c[0], f"{band}_slope": c[1]}
    for k in (1, 2, 3):
        out |= {f"{band}_phase_{k}": H.phase(c, k), f"{band}_amplitude_{k}": H.amplitude(c, k)}
    rmse, magnitude = s[f"{band}_rmse"], s[f"{band}_magnitude"]
    return out | {f"{band}_rmse": rmse, f"{band}_magnitude": magnitude, f"{band}_breakConfidence": magnitude / F.nullif(rmse, F.lit(0.0))}


def date_slice(segments: DataFrame, dates: DataFrame, key: str, bands: Sequence[str], gap: str = "MASK", extrapolate: str = "CLOSEST", most_days: float = 0, waves: int = 3, date_format: int = 0) -> DataFrame:
    """All bands of a slice at each (key, t): values, intercepts, slopes, phases, amplitudes, errors, magnitudes, confidences, and
    the segment's own dates, count and probability.

    ``gap``: MASK (dates outside every segment are masked), EXTRAPOLATE (the PREVIOUS, NEXT or CLOSEST segment is carried on for
    ``most_days``; negative: without end) or INTERPOLATE (between two segments the trend runs straight from the end of one to the
    start of the next, and their waves are blended by nearness; values alone are given, masked before the first and after the last).
    """
    unit, t = UNITS[date_format], F.col("t")
    rows = beside(segments, dates, key)
    before, after = F.col("previous"), F.col("next")
    inside = before["t_end"] >= t
    if gap == "INTERPOLATE":
        share = (t - before["t_end"]) / F.nullif(after["t_start"] - before["t_end"], F.lit(0.0))
        out = []
        for b in bands:
            trend = lambda s, x, b=b: s[f"{b}_coefs"][0] + s[f"{b}_coefs"][1] * x
            wave = lambda s, b=b: H.value(s[f"{b}_coefs"], t, waves, unit) - trend(s, t)
            a, z = trend(before, before["t_end"]), trend(after, after["t_start"])
            between = a + share * (z - a) + (1 - share) * wave(before) + share * wave(after)
            out.append(F.when(inside, H.value(before[f"{b}_coefs"], t, waves, unit)).when(before.isNotNull() & after.isNotNull(), between).alias(b))
        return rows.select(key, "t", *out)
    to_previous, to_next = t - before["t_end"], after["t_start"] - t
    picks = {"PREVIOUS": before, "NEXT": after, "CLOSEST": F.when(to_next < to_previous, after).otherwise(F.coalesce(before, after))}
    found = F.when(inside, before) if gap == "MASK" else F.when(inside, before).otherwise(picks[extrapolate])
    rows = rows.select(key, "t", found.alias("s"))
    s = F.col("s")
    apart = F.greatest(s["t_start"] - t, t - s["t_end"], F.lit(0.0)) / DAYS[date_format]
    near = F.lit(True) if gap == "MASK" or most_days < 0 else apart <= most_days
    columns = {n: c for b in bands for n, c in _bands(s, b, t, waves, unit).items()}
    # only the value itself is masked by distance, as what else is told of a segment does not depend on the date
    columns |= {b: F.when(near, columns[b]) for b in bands}
    return rows.select(key, "t", *(c.alias(n) for n, c in columns.items()), *(s[n].alias(n) for n in ("t_start", "t_end", "t_break", "num_obs", "change_prob")))
