"""Change alerts on time-ordered observations of pixels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def framed_alerts(obs: DataFrame, key: str, order: Sequence[str], changed: Column, frame: int, least: int, must_be_stable: bool = True) -> DataFrame:
    """Alerts of each pixel from frames of ``frame`` consecutive observations with ``least`` changed (or stable) ones.

    ``first_stable``, ``last_stable``: first and last unchanged date of the first and last stable frame;
    ``first_detection``, ``confirmation``: first and last changed date of the first change frame (one that ends after
    the first stable date, if that is required); ``last_detection``: last changed date of the last change frame;
    ``detections``: observations from first to last detection.
    """
    w = Window.partitionBy(key).orderBy(*order)
    ahead = w.rowsBetween(0, frame - 1)
    t = F.col(order[0])
    rows = obs.withColumn("_c", changed.cast("int"))
    rows = rows.withColumns(
        {
            "_size": F.count("*").over(ahead),
            "_changes": F.sum("_c").over(ahead),
            "_end": F.max(t).over(ahead),
            "_first_changed": F.min(F.when(F.col("_c") == 1, t)).over(ahead),
            "_last_changed": F.max(F.when(F.col("_c") == 1, t)).over(ahead),
            "_first_same": F.min(F.when(F.col("_c") == 0, t)).over(ahead),
            "_last_same": F.max(F.when(F.col("_c") == 0, t)).over(ahead),
        }
    )
    full = F.col("_size") == frame
    stable, change = full & (frame - F.col("_changes") >= least), full & (F.col("_changes") >= least)
    start = F.min(F.when(stable, F.col("_first_same"))).over(Window.partitionBy(key))
    rows = rows.withColumns({"_stable": stable, "_from": start})
    rows = rows.withColumn("_change", change & (F.col("_end") > F.col("_from")) if must_be_stable else change)
    at = F.struct(*order)
    spans = rows.groupBy(key).agg(
        F.min("_from").alias("first_stable"),
        F.max(F.when(F.col("_stable"), F.col("_last_same"))).alias("last_stable"),
        F.min_by("_first_changed", F.when(F.col("_change"), at)).alias("first_detection"),
        F.min_by("_last_changed", F.when(F.col("_change"), at)).alias("confirmation"),
        F.max(F.when(F.col("_change"), F.col("_last_changed"))).alias("last_detection"),
    )
    inside = obs.select(key, t.alias("_t")).join(spans.select(key, "first_detection", "last_detection"), key)
    counts = inside.where((F.col("_t") >= F.col("first_detection")) & (F.col("_t") <= F.col("last_detection"))).groupBy(key).agg(F.count("*").alias("detections"))
    return spans.join(counts, key, "left").fillna(0, ["detections"])


def class_alerts(obs: DataFrame, key: str, t: str, cls: str, baseline: DataFrame, from_classes: Sequence[int], to_classes: Sequence[int]) -> DataFrame:
    """Transitions from baseline classes: first change date, then changes, no-changes and occlusions after it."""
    change = F.col("base").isin(list(from_classes)) & F.col(cls).isin(list(to_classes))
    rows = obs.join(baseline, key).withColumn("_change", F.coalesce(change, F.lit(False)))
    first = rows.groupBy(key).agg(F.min(F.when(F.col("_change"), F.col(t))).alias("first_change")).where("first_change is not null")
    after = rows.join(first, key).where(F.col(t) >= F.col("first_change"))
    out = after.groupBy(key, "first_change").agg(
        F.count_if("_change").alias("changes"), F.count_if(~F.col("_change") & F.col(cls).isNotNull()).alias("no_changes"), F.count_if(F.col(cls).isNull()).alias("occluded")
    )
    return out.withColumn("repeatability", 100 * F.col("changes") / F.nullif(F.col("changes") + F.col("no_changes"), F.lit(0)))


def bayesian_alerts(obs: DataFrame, key: str, order: Sequence[str], probability: str, orbit: str) -> DataFrame:
    """Sequential Bayesian alerts: an ordered fold over each pixel's non-forest probabilities.

    State: flag (0 none, 1 suspected, 2 confirmed), probability of change, date of first detection. A pixel's series is
    folded within one row; series are tens to hundreds of observations long.
    """
    item = F.struct(*order, F.col(probability).alias("pnf"), F.col(orbit).alias("orbit"))
    series = obs.where(F.col(probability).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("series"))
    first = order[0]
    state = "named_struct('flag', 0, 'p', double(0), 'pnf', double(0.5), 'orbit', 0L, 'since', cast(null as timestamp_ntz))"
    step = f"""aggregate(series, {state}, (s, x) -> transform(array(named_struct(
        'same', s.orbit = 0 or s.orbit = x.orbit or x.pnf >= 0.6, 'prior', if(s.flag = 0, s.pnf, s.p))), a -> transform(array(
        case when s.flag = 1 and not a.same then s.p when s.flag = 0 and x.pnf < 0.6 then 0d
          else a.prior * x.pnf / (a.prior * x.pnf + (1 - a.prior) * (1 - x.pnf)) end), p -> transform(array(
        case when s.flag = 2 then 2
          when s.flag = 1 and not a.same then 1 when s.flag = 1 and p < 0.5 then 0 when s.flag = 1 and p >= 0.975 then 2 when s.flag = 1 then 1
          when x.pnf >= 0.6 and p >= 0.975 then 2 when x.pnf >= 0.6 then 1 else 0 end), f ->
        named_struct('flag', f, 'p', p, 'pnf', x.pnf, 'orbit', if(f = 0, 0L, if(f <> s.flag, x.orbit, s.orbit)), 'since', if(f = 0, null, if(s.flag = 0, x.{first}, s.since))))[0])[0])[0])"""
    return series.select(key, F.expr(step).alias("s")).select(key, "s.flag", "s.p", F.col("s.since").alias("first_detection"))


def _bell(z: float | None) -> float | None:
    if z is None:
        return None
    try:
        return math.exp(-math.pow(z, 2.0) / 2)
    except OverflowError:  # of the square
        return 0.0


def bell(z: Column) -> Column:
    """exp(-z^2 / 2) as the C library rounds it, which SQL engines use. Spark's own differs in the last bit of some values."""

    @F.arrow_udf("double")
    def run(z: pa.Array) -> pa.Array:
        return pa.array([_bell(v) for v in z.to_pylist()], pa.float64())

    return run(z)


def change_probability(x: Column, mean: Column, std: Column, ratio: float = 1.0) -> Column:
    """Probability of non-forest of an observation: Gaussians at the mean and four deviations below it, clamped.

    Its log odds are linear in the observation, so that series with rounded values come to even odds exactly: there the last bit
    of the Gaussians decides whether a suspicion stays.
    """
    width = 2 * std * ratio
    density = lambda m: bell((x - m) / width)
    changed, same = density(mean - 4 * std * ratio), density(mean)
    return F.least(F.greatest(changed / F.nullif(changed + same, F.lit(0.0)), F.lit(0.05)), F.lit(0.95))


def year_before(obs: DataFrame, segments: DataFrame, key: str, t: str, value: str, coefs: str, rmse: str, least: float, harmonics: int = 3, year: float = 365.25) -> DataFrame:
    """Observations with the model of one year earlier: ``difference`` (model less observation), ``confidence`` (its size over
    rmse) and ``changed`` (confidence above ``least``). The segment nearest to that date gives the model."""
    from ..functions import harmonics as H
    from . import segments as S

    dated = obs.withColumn("_t", F.col(t) - year)
    near = S.nearest(segments, dated.select(key, F.col("_t").alias("t")).distinct(), key, [coefs, rmse])
    rows = dated.join(near.select(F.col(key).alias("_k"), F.col("t").alias("_at"), coefs, rmse), (F.col(key) == F.col("_k")) & (F.col("_t") == F.col("_at"))).where(F.col(coefs).isNotNull())
    difference = H.value(F.col(coefs), F.col("_t"), harmonics) - F.col(value)
    confidence = F.abs(difference) / F.nullif(F.col(rmse), F.lit(0.0))
    return rows.select(*obs.columns, difference.alias("difference"), confidence.alias("confidence"), (confidence > least).alias("changed"))


def segment_alerts(
    obs: DataFrame, segments: DataFrame, key: str, order: Sequence[str], value: str, band: str, monitoring: float, min_confidence: float = 5, frame: int = 3, least: int = 3,
    must_be_stable: bool = True, must_stay: bool = True, must_confirm: bool = True, harmonics: int = 3, year: float = 365.25,
) -> DataFrame:
    """Changes of observations against the segments fitted to earlier ones: a row for each pixel with segments.

    ``order`` begins with the observation's day. It is compared with the model of the same day a year earlier, of the segment that
    holds that day or is nearer to it; masked observations do not count. ``confidence`` and ``difference`` are means from the first
    to the last detection, ``detections`` their number; ``last_stable``, the detections and the means are 0 where there are none, or
    where the alert is not confirmed since ``monitoring``, was there before it, or did not stay, as far as these are required.
    """
    from ..functions import harmonics as H
    from . import slices as L

    seen = obs.where(F.col(value).isNotNull()).withColumn("t", F.col(order[0]) - year)
    own = segments.select(key, "t_start", "t_end", f"{band}_coefs", f"{band}_rmse")
    p, n, t = F.col("previous"), F.col("next"), F.col("t")
    closest = F.when(t - p["t_end"] > n["t_start"] - t, n).otherwise(F.coalesce(p, n))
    near = L.beside(own, seen.select(key, "t"), key).select(F.col(key).alias("_k"), F.col("t").alias("_t"), closest.alias("_s"))
    rows = seen.join(near, (F.col(key) == F.col("_k")) & (t == F.col("_t"))).where("_s is not null")
    difference = H.value(F.col("_s")[f"{band}_coefs"], t, harmonics) - F.col(value)
    sure = F.abs(difference) / F.nullif(F.col("_s")[f"{band}_rmse"], F.lit(0.0))
    rows = rows.select(key, *order, difference.alias("_difference"), sure.alias("_sure")).withColumn("_changed", F.coalesce(F.col("_sure") > min_confidence, F.lit(False)))
    rows = staged(rows, "compared")  # three steps read them
    spans = framed_alerts(rows, key, order, F.col("_changed"), frame, least, must_be_stable).drop("detections")
    if must_be_stable:  # the first change of all, stable before or not
        first = framed_alerts(rows, key, order, F.col("_changed"), frame, least, False).select(F.col(key).alias("_k"), F.col("confirmation").alias("_first"))
        spans = spans.join(first, F.col(key) == F.col("_k"), "left").drop("_k")
    else:
        spans = spans.withColumn("_first", F.col("confirmation"))
    kept = kept_alerts(spans, F.lit(monitoring), F.col("_first") != F.col("confirmation"), must_stay, must_confirm).drop("_first", "first_stable", "last_stable")
    day = F.col(order[0])
    inside = (day >= F.col("first_detection")) & (day <= F.col("last_detection"))
    counts = rows.join(kept.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left").groupBy(key).agg(
        F.avg(F.when(inside, F.col("_sure"))).alias("confidence"), F.avg(F.when(inside, F.col("_difference"))).alias("difference"), F.count_if(inside).alias("detections"),
        F.first("first_detection").alias("first_detection"), F.first("confirmation").alias("confirmation"), F.first("last_detection").alias("last_detection"),
        F.count_if(day >= monitoring).alias("monitoring_observations"), F.count_if(day < monitoring).alias("calibration_observations"),
    )
    every = own.select(key).distinct().join(spans.select(key, "last_stable"), key, "left").join(counts, key, "left")
    return every.fillna(0)


def kept_alerts(alerts: DataFrame, monitoring: Column, in_calibration: Column | None = None, must_stay: bool = True, must_confirm: bool = True) -> DataFrame:
    """Alerts confirmed in the monitoring period, not already in calibration, and that stayed changed, as far as required."""
    test = F.col("confirmation").isNotNull()
    if must_confirm:
        test = test & (F.col("confirmation") >= monitoring)
        if in_calibration is not None:
            test = test & ~in_calibration
    if must_stay:
        test = test & F.coalesce(F.col("last_stable") < F.col("last_detection"), F.lit(True))
    return alerts.where(test)


def bayesian_flags(flag: Column, p: Column, sure: float = 0.85) -> Column:
    """Flags of an alert as users see them: 1 low, 2 high, 3 confirmed; each rule tests the flag as it was."""
    return F.when((flag == 1) & (p >= sure), 2).when((flag == 2) & (p >= sure), 3).otherwise(flag)


def class_alert_details(obs: DataFrame, key: str, t: str, cls: str, index: str, baseline: DataFrame, from_classes: Sequence[int], to_classes: Sequence[int], gate: float | None = None) -> DataFrame:
    """Transitions from baseline classes with an optional gate: the index must have moved by ``gate`` from its baseline.

    ``baseline`` has ``base`` and ``base_index``. Of each pixel with a change: first and last change date, changes, no-changes,
    occlusions and valid observations from the first change on, totals over all dates, repeatability in per cent, and
    the least, mean and largest index change of changed observations.
    """
    moved = F.col(index) - F.col("base_index")
    change = F.col("base").isin(list(from_classes)) & F.col(cls).isin(list(to_classes))
    if gate is not None:
        change = change & (moved >= gate)
    rows = obs.join(baseline, key).withColumns({"_change": F.coalesce(change, F.lit(False)), "_moved": moved})
    first = rows.groupBy(key).agg(F.min(F.when(F.col("_change"), F.col(t))).alias("first_change"), F.max(F.when(F.col("_change"), F.col(t))).alias("last_change"), F.count("*").alias("images"), F.count(cls).alias("valid_images"))
    after = rows.join(first.where("first_change is not null"), key)
    since = F.col(t) >= F.col("first_change")
    moved = F.when(F.col("_change"), F.col("_moved"))
    out = after.groupBy(key, "first_change", "last_change", "images", "valid_images").agg(
        F.count_if(F.col("_change")).alias("changes"), F.count_if(since & ~F.col("_change") & F.col(cls).isNotNull()).alias("no_changes"), F.count_if(since & F.col(cls).isNull()).alias("occluded"),
        F.count_if(since & F.col(cls).isNotNull()).alias("valid"), F.min(moved).alias("least_move"), F.avg(moved).alias("mean_move"), F.max(moved).alias("largest_move"), F.first("base").alias("base"),
    )
    return out.withColumn("repeatability", 100 * F.col("changes") / F.nullif(F.col("valid"), F.lit(0)))
