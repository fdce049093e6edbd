"""Reflectance corrected for sun and view: orders are observations, their keys places inside their customer's footprint."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import brdf as B
from ..registry import query, table

_PI = "pi()"
# Footprints lean; observations lie inside; dates give the year's share, keys the hour.
_PLACES = """o AS (SELECT o_orderkey AS id, (o_custkey % 60 - 30)::DOUBLE AS fx, (o_custkey % 97 - 48)::DOUBLE AS fy, (dayofyear(o_orderdate) - 1) / 365.25 AS share, (o_orderkey % 24)::DOUBLE AS hour, o_totalprice / 500000 AS v,
      (o_orderkey % 10) / 10.0 AS a, (o_orderkey % 7) / 7.0 AS b FROM orders),
    p AS (SELECT *, fx + 0.3 + 1.5 * a + 0.2 * b AS x, fy + 0.1 + 1.6 * b + 0.1 * a AS y FROM o)"""
_SUN = f"""s AS (SELECT *, share * 2 * {_PI} AS turn, radians(y) AS phi FROM p),
    s1 AS (SELECT *, 0.006918 - 0.399912 * cos(turn) + 0.070257 * sin(turn) - 0.006758 * cos(2 * turn) + 0.000907 * sin(2 * turn) - 0.002697 * cos(3 * turn) + 0.00148 * sin(3 * turn) AS delta,
      radians((hour + x / 15 + (0.000075 + 0.001868 * cos(turn) - 0.032077 * sin(turn) - 0.014615 * cos(2 * turn) - 0.040849 * sin(2 * turn)) * 12 / {_PI} - 12) * 15) AS ang FROM s),
    s2 AS (SELECT *, acos(greatest(least(sin(phi) * sin(delta) + cos(phi) * cos(delta) * cos(ang), 1), -1)) AS zen FROM s1),
    s3 AS (SELECT *, greatest(least(cos(delta) * sin(ang) / sin(zen), 1), -1) AS si, (-cos(phi) * sin(delta) + sin(phi) * cos(delta) * cos(ang)) / sin(zen) AS co FROM s2),
    s4 AS (SELECT *, CASE WHEN co <= 0 THEN {_PI} - asin(si) WHEN si <= 0 THEN 2 * {_PI} + asin(si) ELSE asin(si) END + {_PI} AS az0 FROM s3),
    sun AS (SELECT *, CASE WHEN az0 > 2 * {_PI} THEN az0 - 2 * {_PI} ELSE az0 END AS az FROM s4)"""
_GAP = "sqrt(pow(({0} - x) * cos(radians(y)) * 111320 + {4} * (({2}) - ({0})) * cos(radians(y)) * 111320, 2) + pow(({1} - y) * 111320 + {4} * (({3}) - ({1})) * 111320, 2))"
_SHARE = "greatest(least(-(({0} - x) * (({2}) - ({0})) * pow(cos(radians(y)), 2) + ({1} - y) * (({3}) - ({1}))) / (pow((({2}) - ({0})) * cos(radians(y)), 2) + pow(({3}) - ({1}), 2)), 1), 0)"


def _away(x0: str, y0: str, x1: str, y1: str) -> str:
    return _GAP.format(x0, y0, x1, y1, _SHARE.format(x0, y0, x1, y1))


# corners of the footprint: lower left (fx, fy), lower right (fx + 2, fy + 0.2), upper right (fx + 2.4, fy + 2.1), upper left (fx + 0.4, fy + 1.9)
_LEFT, _RIGHT = _away("fx + 0.4", "fy + 1.9", "fx", "fy"), _away("fx + 2.4", "fy + 2.1", "fx + 2", "fy + 0.2")
_VIEW = f"w AS (SELECT *, {_LEFT} AS dl, {_RIGHT} AS dr FROM sun), view AS (SELECT *, radians(dr * 15 / (dr + dl) - 7.5) AS vz, {_PI} / 2 - atan(-0.4 / 1.9) AS va FROM w)"
_ZEN = "radians(31.0076 - 0.1272 * {0} + 0.01187 * pow({0}, 2) + 2.4e-5 * pow({0}, 3) - 9.48e-7 * pow({0}, 4) - 1.95e-9 * pow({0}, 5) + 6.15e-11 * pow({0}, 6))"


def _kernels(sun: str, view: str, az: str) -> str:
    """SQL of both kernels, from the formulas as they are published."""
    ph = f"greatest(least(cos({sun}) * cos({view}) + sin({sun}) * sin({view}) * cos({az}), 1), -1)"
    a, b = f"greatest(tan({sun}), 0)", f"greatest(tan({view}), 0)"
    sec = f"(sqrt(1 + pow({a}, 2)) + sqrt(1 + pow({b}, 2)))"
    t = f"acos(greatest(least(2 * sqrt(greatest(pow({a}, 2) + pow({b}, 2) - 2 * {a} * {b} * cos({az}), 0) + pow({a} * {b} * sin({az}), 2)) / {sec}, 1), -1))"
    php = f"greatest(least((1 + {a} * {b} * cos({az})) / sqrt(1 + pow({a}, 2)) / sqrt(1 + pow({b}, 2)), 1), -1)"
    li = f"least(({t} - sin({t}) * cos({t})) * {sec} / {_PI}, 0) - {sec} + (1 + cos({php})) / 2 * sqrt(1 + pow({a}, 2)) * sqrt(1 + pow({b}, 2))"
    return f"(({_PI} / 2 - acos({ph})) * {ph} + sin(acos({ph}))) / (cos({sun}) + cos({view})) - {_PI} / 4 AS {{0}}v, {li} AS {{0}}g"


_CORRECTED = f"""k AS (SELECT *, {_kernels('zen', 'vz', '(az - va)').format('k')}, {_kernels('z0', '0', '0').format('n')} FROM (SELECT *, {_ZEN.format('(fy + 1)')} AS z0 FROM view))"""
_BAND = "round(v * ({0} + 4 * {2} * nv + {1} * ng) / ({0} + 4 * {2} * kv + {1} * kg), 6)"


def _places(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").select(
        k.alias("id"), (c % 60 - 30).cast("double").alias("fx"), (c % 97 - 48).cast("double").alias("fy"), ((F.dayofyear("o_orderdate") - 1) / 365.25).alias("share"), (k % 24).cast("double").alias("hour"),
        (F.col("o_totalprice") / 500000).alias("v"), (k % 10 / 10.0).alias("a"), (k % 7 / 7.0).alias("b"),
    )
    fx, fy, a, b = (F.col(n) for n in ("fx", "fy", "a", "b"))
    ring = F.array(*(F.struct((fx + i).alias("x"), (fy + j).alias("y")) for i, j in ((1.0, 0.1), (2.0, 0.2), (2.4, 2.1), (1.4, 2.0), (0.4, 1.9), (0.0, 0.0))))
    return o.select("*", (fx + 0.3 + 1.5 * a + 0.2 * b).alias("x"), (fy + 0.1 + 1.6 * b + 0.1 * a).alias("y"), ring.alias("ring"))


@query(f"WITH {_PLACES}, {_SUN} SELECT id, round(az, 6) AS azimuth, round(zen, 6) AS zenith, round({_ZEN.format('y')}, 6) AS normal_zenith FROM sun")
def solar_position(spark, d):
    p = _places(spark, d)
    azimuth, zenith = B.sun_angles(F.col("share"), F.col("hour"), F.col("x"), F.col("y"))
    return p.select("id", F.round(azimuth, 6).alias("azimuth"), F.round(zenith, 6).alias("zenith"), F.round(B.sun_zenith_out(F.col("y")), 6).alias("normal_zenith"))


@query(f"WITH {_PLACES}, sun AS (SELECT * FROM p), {_VIEW} SELECT id, round(va, 6) AS azimuth, round(vz, 6) AS zenith FROM view")
def swath_geometry(spark, d):
    p = _places(spark, d)
    azimuth, zenith = B.swath_angles(F.col("x"), F.col("y"), B.corners(F.col("ring")), 7.5)
    return p.select("id", F.round(azimuth, 6).alias("azimuth"), F.round(zenith, 6).alias("zenith"))


@query(f"WITH {_PLACES}, {_SUN}, {_VIEW}, {_CORRECTED} SELECT id, {', '.join(_BAND.format(*c) + f' AS {n}' for n, c in B.COEFFICIENTS.items())} FROM k WHERE zen < 1.2")
def brdf_correction(spark, d):
    """Every band by day (the sun well over the horizon), normalised to the latitude of its footprint's middle."""
    p = _places(spark, d).select("*", *(c.alias(n) for n, c in B.corners(F.col("ring")).items()))
    azimuth, zenith = B.sun_angles(F.col("share"), F.col("hour"), F.col("x"), F.col("y"))
    p = p.select("*", azimuth.alias("sun_azimuth"), zenith.alias("sun_zenith")).where("sun_zenith < 1.2")
    at = {n: F.col(n) for n in ("lower_left", "lower_right", "upper_right", "upper_left")}
    azimuth, zenith = B.swath_angles(F.col("x"), F.col("y"), at, 7.5)
    p = p.select("*", azimuth.alias("view_azimuth"), zenith.alias("view_zenith"))
    pair = lambda n: (F.col(f"{n}_azimuth"), F.col(f"{n}_zenith"))
    out = B.corrected({n: F.col("v") for n in B.COEFFICIENTS}, pair("sun"), pair("view"), F.col("fy") + 1)
    return p.select("id", *(F.round(c, 6).alias(n) for n, c in out.items()))
