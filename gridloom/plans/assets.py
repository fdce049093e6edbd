"""Single assets, radar time scans, training rows and dates of monitoring. Line items are pixels, customers a grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import filters, learning, radar, tiles
from ..registry import query, table
from ..sources import scenes
from .neighbourhoods import _G, grid


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.03 THEN l_tax END AS tax FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_extendedprice BETWEEN 10000 AND 50000")
def image_asset(spark, d):
    """Masked, its bands selected, clipped to a box."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("quality"))
    masked = filters.masked(li, ["tax"], filters.pixel_mask([{"band": "quality", "constraints": [{"op": ">=", "value": 0.03}]}]))
    return scenes.clipped(masked.select("l_orderkey", "l_linenumber", "x", "y", "tax"), "x", "y", (10, 10000, 30, 50000)).drop("x", "y")


@query("SELECT month(o_orderdate)::INTEGER AS month, count(*) AS n FROM orders WHERE month(o_orderdate) IN (12, 13) GROUP BY 1")
def calendar_december(spark, d):
    return table(spark, d, "orders").where(dates.two_months(F.col("o_orderdate"), 12)).groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate::DATE AS monitoring_end, (o_orderdate::DATE - INTERVAL 3 MONTH)::DATE AS monitoring_start, (o_orderdate::DATE - INTERVAL 3 MONTH - INTERVAL 12 MONTH)::DATE AS calibration_start FROM orders")
def monitoring_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *dates.monitoring(F.col("o_orderdate").cast("date"), 3, 12))


@query(
    """SELECT l_suppkey AS pixel, round(avg(l_quantity), 6) AS vv_mean, min(l_quantity) AS vv_min, max(l_tax) AS vh_max, round(stddev_pop(l_tax), 8) AS vh_std, round(median(l_quantity) - median(l_tax), 6) AS ratio,
    round(10 * log10(stddev_pop(l_quantity) / avg(pow(10, l_quantity / 10))), 5) AS vv_cv FROM lineitem GROUP BY 1"""
)
def radar_time_scan_bands(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.col("l_quantity").alias("vv"), F.col("l_tax").alias("vh"))
    out = radar.time_scan(li, ["pixel"], ["vv", "vh"])
    return out.select("pixel", F.round("vv_mean", 6).alias("vv_mean"), "vv_min", "vh_max", F.round("vh_std", 8).alias("vh_std"), F.round("ratio", 6).alias("ratio"), F.round("vv_cv", 5).alias("vv_cv"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / cos(radians(l_quantity)), 4) AS gamma0, l_quantity > 30.63993 AND l_quantity < 45.23993 AS inside FROM lineitem")
def radar_swath(spark, d):
    angle = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(radar.gamma0(F.col("l_extendedprice"), angle), 4).alias("gamma0"), radar.inside_swath(angle).alias("inside"))


@query("SELECT l_suppkey AS pixel, round(avg(l_quantity) FILTER (WHERE l_linenumber % 2 = 0), 6) AS v_mean_asc, round(stddev_pop(l_quantity) FILTER (WHERE l_linenumber % 2 = 0), 6) AS v_std_asc, round(avg(l_quantity) FILTER (WHERE l_linenumber % 2 = 1), 6) AS v_mean_desc, round(stddev_pop(l_quantity) FILTER (WHERE l_linenumber % 2 = 1), 6) AS v_std_desc FROM lineitem GROUP BY 1")
def orbit_history(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.when(F.col("l_linenumber") % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("orbit"), F.col("l_quantity").alias("v"))
    out = radar.orbit_history(li, "pixel", "orbit", ["v"])
    return out.select("pixel", *(F.round(c, 6).alias(c) for c in out.columns if c != "pixel"))


@query(
    f"""WITH {_G}, p AS (SELECT x, y, v + 2000 AS v FROM g), f AS (SELECT a.x, a.y, avg(b.v) AS m, sqrt(var_pop(b.v)) AS s FROM p a JOIN p b ON b.x BETWEEN a.x-1 AND a.x+1 AND b.y BETWEEN a.y-1 AND a.y+1 GROUP BY 1, 2),
    c AS (SELECT x, y, v, m, s / m AS ci, 1.25 / nullif(s * s / m / m - 0.25, 0) AS al FROM f JOIN p USING (x, y))
    SELECT x, y, round(CASE WHEN ci <= 0.5 THEN m WHEN ci < sqrt(0.5) THEN ((al - 5) * m + sqrt(greatest(m * m * pow(al - 5, 2) + 16 * al * m * v, 0))) / (2 * al) ELSE v END + 1e-6, 3) AS filtered FROM c"""
)
def speckle_gamma_map(spark, d):
    g = grid(spark, d).withColumn("v", F.col("v") + 2000)
    return radar.gamma_map(g, "v", 1).select("x", "y", F.round(F.col("filtered") + 1e-6, 3).alias("filtered"))


@query(f"WITH {_G}, k AS (SELECT x AS a, y AS b FROM g WHERE v < -500), j AS (SELECT x, y, min((x - a) * (x - a) + (y - b) * (y - b)) AS d2 FROM g JOIN k ON a BETWEEN x - 3 AND x + 3 AND b BETWEEN y - 3 AND y + 3 GROUP BY 1, 2) SELECT g.x, g.y, round(sqrt(d2), 6) AS distance FROM g LEFT JOIN j ON g.x = j.x AND g.y = j.y")
def distance_transform(spark, d):
    return radar.distance_to(grid(spark, d), F.col("v") < -500, 3).select("x", "y", F.round("distance", 6).alias("distance"))


@query(f"WITH {_G}, k AS (SELECT x AS a, y AS b FROM g WHERE v < -900) SELECT x, y, round(sqrt(min((x - a) * (x - a) + (y - b) * (y - b))), 6) AS distance FROM g LEFT JOIN k ON true GROUP BY 1, 2")
def distance_unbounded(spark, d):
    """Exact at any distance."""
    return tiles.distance_transform(grid(spark, d), F.col("v") < -900).select("x", "y", F.round("distance", 6).alias("distance"))


_NEAR = "(SELECT a.x, a.y, avg(b.v) AS m, var_pop(b.v) AS z FROM {0} a LEFT JOIN {1} b ON b.x BETWEEN a.x - {2} AND a.x + {2} AND b.y BETWEEN a.y - {2} AND a.y + {2} GROUP BY 1, 2)"
_MMSE = "coalesce((1 - greatest((z - pow(greatest(m, 0), 2) * {0}) / {1} / nullif(z, 0), 0)) * greatest(m, 0) + greatest((z - pow(greatest(m, 0), 2) * {0}) / {1} / nullif(z, 0), 0) * v, greatest(m, 0))"


@query(
    f"""WITH {_G}, p AS (SELECT x, y, v + 1000 AS v FROM g), f AS {_NEAR.format('p', 'p', 1)}, e AS (SELECT x, y, v, {_MMSE.format(0.25, 1.25)} AS guess FROM f JOIN p USING (x, y)),
    k AS (SELECT x, y, v FROM e WHERE v >= 0.378 * guess AND v < 2.094 * guess), h AS {_NEAR.format('p', 'k', 2)}
    SELECT x, y, round(CASE WHEN v > 10500 THEN v ELSE {_MMSE.format(0.3991 ** 2, 1 + 0.3991 ** 2)} END + 1e-6, 3) AS filtered FROM h JOIN p USING (x, y)"""
)
def speckle_lee_sigma(spark, d):
    g = grid(spark, d).withColumn("v", F.col("v") + 1000)
    return tiles.lee_sigma(g, "v", 2, 0.9, 0.5, 10500, 16).select("x", "y", F.round(F.col("filtered") + 1e-6, 3).alias("filtered"))


@query()
def speckle_refined_lee(spark, d):
    """Tested against loops over single pixels."""
    return tiles.refined_lee(grid(spark, d).withColumn("v", F.col("v") + 1000), "v", side=16).select("x", "y", F.round("filtered", 3).alias("filtered"))


_SLOPE = """n AS (SELECT g.x, g.y, g.v, (e.v - w.v) / 2000 AS ge, (n.v - s.v) / 2000 AS gn FROM g LEFT JOIN g e ON e.x = g.x + 1 AND e.y = g.y LEFT JOIN g w ON w.x = g.x - 1 AND w.y = g.y LEFT JOIN g s ON s.x = g.x AND s.y = g.y + 1 LEFT JOIN g n ON n.x = g.x AND n.y = g.y - 1),
    t AS (SELECT x, y, v, atan(sqrt(ge * ge + gn * gn)) AS slope, CASE WHEN ge IS NOT NULL AND gn IS NOT NULL THEN CASE WHEN atan2(-ge, -gn) < 0 THEN atan2(-ge, -gn) + 2 * pi() ELSE atan2(-ge, -gn) END END AS aspect FROM n)"""


@query(f"WITH {_G}, {_SLOPE} SELECT x, y, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM t")
def terrain_slope(spark, d):
    out = tiles.slope_aspect(grid(spark, d), "v", 1000.0)
    return out.select("x", "y", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


_FLAT = f"""{_SLOPE}, a AS (SELECT x, y, 1 + v / 10000 AS b, radians(25 + x * 0.5) AS th, atan(tan(slope) * cos(1.4 - CASE WHEN aspect > pi() THEN aspect - 2 * pi() ELSE aspect END)) AS ar, atan(tan(slope) * sin(1.4 - CASE WHEN aspect > pi() THEN aspect - 2 * pi() ELSE aspect END)) AS az FROM t),
    m AS (SELECT *, coalesce(ar < th AND ar > th - pi() / 2, false) AS ok FROM a)"""


def _flattened(spark, d, model, buffer):
    g = tiles.slope_aspect(grid(spark, d), "v", 1000.0).withColumn("b", 1 + F.col("v") / 10000)
    out = tiles.terrain_flattened(g, ["b"], F.radians(25 + F.col("x") * 0.5), F.lit(1.4), model, buffer)
    return out.select("x", "y", F.round("b", 5).alias("b"))


@query(f"WITH {_G}, {_FLAT} SELECT x, y, round(CASE WHEN ok THEN b / cos(th) / (tan(pi() / 2 - th + ar) / tan(pi() / 2 - th)) END, 5) AS b FROM m")
def terrain_volume(spark, d):
    return _flattened(spark, d, "volume", 0.0)


@query(f"WITH {_G}, {_FLAT}, o AS (SELECT m.*, NOT EXISTS (SELECT 1 FROM m k WHERE NOT k.ok AND (k.x - m.x) * (k.x - m.x) + (k.y - m.y) * (k.y - m.y) <= 1) AS clear FROM m) SELECT x, y, round(CASE WHEN ok AND clear THEN b / cos(th) / (cos(pi() / 2 - th) / (cos(az) * cos(pi() / 2 - th + ar))) END, 5) AS b FROM o")
def terrain_surface(spark, d):
    """With a buffer of a pixel around layover and shadow."""
    return _flattened(spark, d, "surface", 1.0)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 9 END END AS mapped, CASE WHEN c_nationkey <> 0 THEN 4 WHEN c_custkey % 2 <> 0 THEN 5 END AS hot FROM customer")
def training_classes(spark, d):
    c = table(spark, d, "customer").withColumn("odd", F.col("c_custkey") % 2)
    return c.select("c_custkey", learning.mapped_class(F.col("c_acctbal") > 0, {"BUILDING": 1, "MACHINERY": 2}, "c_mktsegment", 9).alias("mapped"), learning.one_hot_class({"c_nationkey": 4, "odd": 5}).alias("hot"))


@query("SELECT stratum, cell FROM (SELECT c_mktsegment AS stratum, c_custkey AS cell, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ('0x'||substr(md5('a:'||c_custkey),1,8))::BIGINT, c_custkey) AS k FROM customer WHERE c_custkey % 100 < 75) WHERE k <= 5")
def next_reference_points(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("cell"), (F.col("c_custkey") % 100).alias("class_probability"))
    return learning.next_points(c, "stratum", "class_probability", ["cell"], "a").select("stratum", "cell")
