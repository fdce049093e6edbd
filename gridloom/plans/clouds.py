"""Masks of observations and mosaics of prepared ones. Line items are observations, their keys hold quality bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clouds, dates, indexes
from ..functions.masks import ratio
from ..operators import composite as C
from ..registry import query, table

_SURE = "((o_orderkey >> {0}) & 3) = 3"


@query(f"SELECT o_orderkey, (o_orderkey & 1) = 1 AS fill, ((o_orderkey >> 1) & 1) = 1 AS dilated, {_SURE.format(8)} AS cloud, {_SURE.format(10)} AS shadow, {_SURE.format(14)} AS cirrus, NOT ((o_orderkey & 1) = 1 OR ((o_orderkey >> 8) & 3) >= 2 OR ((o_orderkey >> 10) & 3) >= 2) AS kept FROM orders")
def quality_masks(spark, d):
    qa = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in clouds.quality_flags(qa).items()), clouds.quality_mask(qa, "AGGRESSIVE", False, False).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_quantity > 40 AS by_probability, l_discount < 0.05 AS by_score FROM lineitem")
def cloud_thresholds(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clouds.by_probability(F.col("l_quantity"), 40).alias("by_probability"), clouds.by_score_plus(F.col("l_discount"), 0.05).alias("by_score"))


def bands(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("pixel"), F.col("l_shipdate").alias("ts"), (F.col("l_discount") + 0.02).alias("blue"), (F.col("l_tax") + 0.05).alias("green"), (F.col("l_quantity") / 200).alias("red"), (F.col("l_extendedprice") / 200000).alias("nir"), (F.col("l_linenumber") / 20).alias("swir1"), (F.col("l_linenumber") / 25).alias("swir2"))


_BANDS = "b AS (SELECT l_orderkey, l_linenumber, l_suppkey AS pixel, l_shipdate AS ts, l_discount + 0.02 AS blue, l_tax + 0.05 AS green, l_quantity / 200 AS red, l_extendedprice / 200000 AS nir, l_linenumber / 20 AS swir1, l_linenumber / 25 AS swir2 FROM lineitem)"
_N = "least(greatest(({0} - {1}) / ({2} - {1}), 0), 1)"
_NDSI = "(green - swir1) / (green + swir1)"


@query(
    f"""WITH {_BANDS}, m AS (SELECT *, (blue + green + red) / 3 AS mean, {_NDSI} AS ndsi, (nir - red) / (nir + red) AS ndvi FROM b),
    h AS (SELECT *, least(50 * greatest(blue - 0.5 * red - 0.06, 0), 1) AS haze, least(1 - greatest(abs(ndvi), abs(ndsi), abs((blue - mean) / mean) + abs((green - mean) / mean) + abs((red - mean) / mean)), 0.1) AS v, 100 * pow(red - 0.15, 2) AS thick FROM m)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN v > -0.5 THEN greatest(1 - (haze + v + green / 10 / 0.04 + thick) / 10, 0) END, 6) AS haze FROM h"""
)
def haze_scores(spark, d):
    b = {n: F.col(n) for n in ("blue", "green", "red", "nir", "swir1", "swir2")}
    return bands(spark, d).select("l_orderkey", "l_linenumber", F.round(clouds.haze_score(b, F.col("red"), F.col("green") / 10), 6).alias("haze"))


@query(
    f"""WITH {_BANDS}, s AS (SELECT *, {_NDSI} AS ndsi, least({_N.format('blue', 0.1, 0.5)}, {_N.format('red+green+blue', 0.2, 0.8)}, {_N.format('nir+swir1+swir2', 0.3, 0.8)}, {_N.format(_NDSI, 0.8, 0.6)}) AS plain,
      least(greatest({_N.format('blue', 0.1, 0.5)}, {_N.format('red', 0.1, 0.5)}), {_N.format('red+green+blue', 0.2, 0.8)}, {_N.format('nir+swir1+swir2', 0.3, 0.8)}, {_N.format(_NDSI, 0.8, 0.6)}) AS score FROM b)
    SELECT l_orderkey, l_linenumber, NOT (blue / swir1 < 0.55 OR nir / swir1 < 0.9) AND NOT ({_N.format('ndsi', 0.2, 0.42)} * {_N.format('nir', 0.15, 0.35)} * {_N.format('blue/red', 0.18, 0.22)} * {_N.format('ndsi', 0.85, 0.95)} > 0.12) AND (score > 0.25 OR (score > 0 AND red > 0.2)) AS cloud FROM s"""
)
def cloud_by_score(spark, d):
    b = {n: F.col(n) for n in ("blue", "green", "red", "nir", "swir1", "swir2")}
    return bands(spark, d).select("l_orderkey", "l_linenumber", clouds.cloud_by_score(b, 25, F.col("red"), F.lit(1.0)).alias("cloud"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.06 THEN 51 WHEN l_discount > 0.05 THEN 37 WHEN l_quantity > 25 THEN 12 ELSE 0 END::INTEGER AS code, CASE WHEN l_tax > 0.06 OR l_discount > 0.05 THEN false ELSE l_quantity > 25 END AS cloud FROM lineitem")
def cascade_codes(spark, d):
    code = clouds.cascade([(F.col("l_quantity") > 25, 12), (F.col("l_discount") > 0.05, 37), (F.col("l_tax") > 0.06, 51)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"), clouds.clear_codes(code).alias("cloud"))


@query(f"WITH {_BANDS}, p AS (SELECT *, nir / greatest(red, green, blue) AS s FROM b) SELECT l_orderkey, l_linenumber, round(red * s + 1e-10, 8) AS red, round(green * s + 1e-10, 8) AS green, round(blue * s + 1e-10, 8) AS blue FROM p")
def pan_sharpening(spark, d):
    df = bands(spark, d)
    red, green, blue = clouds.pan_sharpened(F.col("red"), F.col("green"), F.col("blue"), F.col("nir"))
    return df.select("l_orderkey", "l_linenumber", F.round(red + 1e-10, 8).alias("red"), F.round(green + 1e-10, 8).alias("green"), F.round(blue + 1e-10, 8).alias("blue"))


@query(
    f"""WITH {_BANDS}, p AS (SELECT pixel, red, nir, green, dayofyear(ts) AS doy FROM b WHERE NOT (blue / swir1 < 0.55 OR nir / swir1 < 0.9)),
    m AS (SELECT pixel, median(red) AS red, median(nir) AS nir, median(green) AS green, median(least(abs(doy - 180), 365 - abs(doy - 180))) AS days FROM p GROUP BY 1)
    SELECT pixel, round(10000 * red)::INTEGER AS red, round(10000 * nir)::INTEGER AS nir, floor(10000 * (nir - red) / (nir + red) + 0.5)::INTEGER AS ndvi, days FROM m"""
)
def optical_mosaic(spark, d):
    """Prepared, masked observations to medians, then indexes of the medians as whole ten-thousandths."""
    b = {n: F.col(n) for n in ("blue", "nir", "swir1")}
    steps = {
        "dates": lambda df: df.withColumn("days", dates.circular_days(F.dayofyear("ts"), F.lit(180))),
        "mask_clouds": lambda df: df.where(~F.col("soil")),
        "soil": lambda df: df.withColumn("soil", indexes.soil(b)),
    }
    medians = C.composite(clouds.prepared(bands(spark, d), steps), ["pixel"], ["red", "nir", "green", "days"], "MEDIAN")
    whole = lambda c: F.floor(10000 * c + 0.5).cast("int")
    return medians.select("pixel", F.round(10000 * F.col("red")).cast("int").alias("red"), F.round(10000 * F.col("nir")).cast("int").alias("nir"), whole(ratio(F.col("nir") - F.col("red"), F.col("nir") + F.col("red"))).alias("ndvi"), "days")


@query(
    """WITH w AS (SELECT l_suppkey AS pixel, l_shipdate AS ts, l_quantity AS vv, l_tax AS vh, l_orderkey, l_linenumber, date_diff('day', DATE '1996-07-01', l_shipdate::DATE) AS off FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-07-01' - INTERVAL 183 DAY AND l_shipdate < TIMESTAMP '1996-07-01' + INTERVAL 183 DAY)
    SELECT pixel, median(vv) AS vv_med, stddev_pop(vv) IS NOT NULL AS has_sd, arg_min(vv, (abs(off), ts, l_orderkey, l_linenumber)) AS vv_nearest, min(abs(off))::INTEGER AS days, count(*) AS n FROM w GROUP BY 1"""
)
def radar_mosaic(spark, d):
    """Half a year around the target: medians over time, and the observation nearest to the date."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("vv"), "l_orderkey", "l_linenumber")
    near = li.where("ts >= timestamp '1996-07-01' - interval 183 days and ts < timestamp '1996-07-01' + interval 183 days").withColumn("off", F.abs(F.datediff("ts", F.lit("1996-07-01").cast("date"))))
    return near.groupBy("pixel").agg(F.median("vv").alias("vv_med"), F.stddev_pop("vv").isNotNull().alias("has_sd"), F.min_by("vv", F.struct("off", "ts", "l_orderkey", "l_linenumber")).alias("vv_nearest"), F.min("off").alias("days"), F.count("*").alias("n"))
