"""Tiled neighbourhoods against loops over single pixels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import brdf
from gridloom.operators import tiles


def grid(seed=1, w=23, h=19, missing=0.0):
    rng = random.Random(seed)
    return {(x, y): 100 + 60 * math.sin(x / 3) + 40 * (y > x) + rng.random() * 30 for x in range(-3, w - 3) for y in range(h) if rng.random() >= missing}


def table(spark, pixels):
    return spark.createDataFrame([(x, y, float(v)) for (x, y), v in pixels.items()], "x long, y long, v double")


def stats(pixels, x, y, offsets):
    v = [pixels[x + a, y + b] for a, b in offsets if (x + a, y + b) in pixels]
    return (np.mean(v), np.var(v)) if v else (None, None)


SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def refined(pixels, x, y):
    around = [(a, b) for b in (-2, 0, 2) for a in (-2, 0, 2)]
    s = [stats(pixels, x + a, y + b, SQUARE) for a, b in around]
    if any(m is None for m, _ in s):
        return None
    m = [a for a, _ in s]
    noise = np.mean(sorted(v / a**2 for a, v in s)[:5])
    pairs = ((1, 7), (6, 2), (3, 5), (0, 8))
    g = [abs(m[a] - m[b]) for a, b in pairs]
    if g.count(max(g)) > 1:
        return None
    k = g.index(max(g))
    a, b = pairs[k]
    direction = k + 1 if m[a] - m[4] > m[4] - m[b] else k + 5
    half = {(i, j) for i in range(-3, 4) for j in range(-3, 4) if (j >= 0 if direction % 2 else i <= j)}
    for _ in range((direction - 1) // 2):
        half = {(-j, i) for i, j in half}  # a quarter turn clockwise, y downwards
    mean, var = stats(pixels, x, y, sorted(half))
    share = (var - mean**2 * noise) / (1 + noise) / var if var else None
    return mean if share is None else mean + share * (pixels[x, y] - mean)


def test_refined_lee_equals_loops(spark):
    for missing in (0.0, 0.1):
        pixels = grid(2, missing=missing)
        got = {(r.x, r.y): r.filtered for r in tiles.refined_lee(table(spark, pixels), "v", side=8).collect()}
        assert got.keys() == pixels.keys()
        for p in pixels:
            want = refined(pixels, *p)
            assert (got[p] is None) == (want is None) and (want is None or got[p] == pytest.approx(want)), p


def test_tiles_do_not_show(spark):
    pixels = grid(3, missing=0.05)
    one, many = ({(r.x, r.y): r.filtered for r in tiles.lee_sigma(table(spark, pixels), "v", 3, side=side).collect()} for side in (256, 5))
    assert one.keys() == many.keys() == pixels.keys()
    assert all(a == pytest.approx(b) for a, b in zip((one[p] for p in pixels), (many[p] for p in pixels)))
    assert tiles.lee_sigma(table(spark, {}), "v", 3).collect() == []


def test_distances_equal_a_search(spark):
    for seed, missing, flagged in ((4, 0.0, 0.03), (5, 0.5, 0.05), (6, 0.3, 0.5), (7, 0.2, 0.0)):
        pixels, rng = grid(seed, missing=missing), random.Random(seed)
        marked = {p for p in pixels if rng.random() < flagged}
        df = spark.createDataFrame([(x, y, (x, y) in marked if (x + y) % 9 else None if (x, y) not in marked else True) for x, y in pixels], "x long, y long, f boolean")
        got = {(r.x, r.y): r.distance for r in tiles.distance_transform(df, F.col("f")).collect()}
        assert got.keys() == pixels.keys()
        for x, y in pixels:
            want = min((math.dist((x, y), p) for p in marked), default=None)
            assert got[x, y] == (pytest.approx(want) if want is not None else None)


def test_slopes_of_a_plane(spark):
    """Falls to the north-east: 1 in 2 along each axis."""
    df = spark.createDataFrame([(x, y, -5.0 * x + 5.0 * y) for x in range(4) for y in range(4)], "x long, y long, v double")
    inside = tiles.slope_aspect(df, "v", 10.0).where("slope is not null").collect()
    assert len(inside) == 4
    assert all(r.slope == pytest.approx(math.atan(math.hypot(0.5, 0.5))) and r.aspect == pytest.approx(math.pi / 4) for r in inside)


def test_flat_ground_keeps_backscatter(spark):
    df = spark.createDataFrame([(0, 0, 0.5, 0.0, 0.0), (1, 0, 0.5, 1.2, 1.0), (2, 0, 0.5, None, None)], "x long, y long, b double, slope double, aspect double")
    for model in ("volume", "surface"):
        flat, steep, none = tiles.terrain_flattened(df, ["b"], F.lit(0.6), F.lit(1.0), model).orderBy("x").collect()
        expected = 0.5 / math.cos(0.6) / (1 if model == "volume" else 1)
        assert flat.b == pytest.approx(expected) and steep.b is None and none.b is None


def test_orbit_geometry(spark):
    """A track to the north: points east of it are seen to the right, at the angle of their distance."""
    df = spark.createDataFrame([(0.5, 0.0), (-0.5, 0.0), (0.0, 0.3)], "x double, y double")
    line = (F.lit(0.0), F.lit(-5.0), F.lit(0.0001), F.lit(5.0))
    azimuth, zenith = brdf.orbit_angles(F.col("x"), F.col("y"), *line)
    rows = df.select(azimuth.alias("a"), zenith.alias("z")).collect()
    away = math.atan(0.5 * brdf.METRES / brdf.ALTITUDE)
    assert rows[0].z == pytest.approx(away, rel=1e-3) and rows[1].z == pytest.approx(-away, rel=1e-3) and abs(rows[2].z) < 1e-4
    assert all(r.a == pytest.approx(math.pi / 2, abs=1e-4) for r in rows)


def test_straight_down_under_the_normal_sun_changes_nothing(spark):
    lat, zero = F.lit(12.0), F.lit(0.0)
    out = brdf.corrected({"red": F.lit(0.2), "thermal": F.lit(300.0)}, (zero, brdf.sun_zenith_out(lat)), (zero, zero), lat)
    r = spark.range(1).select(*(c.alias(n) for n, c in out.items())).first()
    assert r.red == pytest.approx(0.2) and r.thermal == 300.0
