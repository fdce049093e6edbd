"""Windows over a grid, tiles and boxes. Customers are the pixels of a grid 40 wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbourhood as N
from ..registry import query, table

_G = "g AS (SELECT c_custkey % 40 AS x, c_custkey // 40 AS y, c_acctbal AS v FROM customer)"
_F = f"WITH {_G}, f AS (SELECT a.x, a.y, count(*) AS n, avg(b.v) AS m, var_pop(b.v) AS z FROM g a JOIN g b ON b.x BETWEEN a.x-1 AND a.x+1 AND b.y BETWEEN a.y-1 AND a.y+1 GROUP BY 1, 2)"


def grid(spark, d):
    c = table(spark, d, "customer")
    return c.select((F.col("c_custkey") % 40).alias("x"), F.floor(F.col("c_custkey") / 40).alias("y"), F.col("c_acctbal").alias("v"))


@query(f"{_F} SELECT x, y, n, round(m,5) AS mean, round(z,2) AS variance FROM f")
def focal_statistics(spark, d):
    return N.focal(grid(spark, d), "v", 1).select("x", "y", "n", F.round("mean", 5).alias("mean"), F.round("variance", 2).alias("variance"))


@query(
    f"""{_F}, l AS (SELECT g.x, g.y, greatest(m,0) AS m, v, greatest(((z - greatest(m,0)*greatest(m,0)*0.25)/1.25)/nullif(z,0), 0) AS b FROM f JOIN g USING (x, y))
    SELECT x, y, round(coalesce((1-b)*m + b*v, m),5) AS filtered FROM l"""
)
def speckle_lee(spark, d):
    return N.lee(grid(spark, d), "v", 1).select("x", "y", F.round("filtered", 5).alias("filtered"))


@query(f"WITH {_G}, c AS (SELECT * FROM g WHERE v > 9000) SELECT x, y, EXISTS (SELECT 1 FROM c WHERE c.x BETWEEN g.x-2 AND g.x+2 AND c.y BETWEEN g.y-2 AND g.y+2) AS near FROM g")
def cloud_buffer(spark, d):
    return N.buffered(grid(spark, d), F.col("v") > 9000, 2).select("x", "y", "near")


@query(
    """WITH b AS (SELECT n_nationkey AS id, n_nationkey*1.5 AS x0, n_nationkey*0.7 AS y0, n_nationkey*1.5+5.2 AS x1, n_nationkey*0.7+3.1 AS y1 FROM nation),
    t AS (SELECT *, unnest(generate_series(floor(x0/2)::BIGINT, (ceil(x1/2)-1)::BIGINT)) AS i FROM b), u AS (SELECT *, unnest(generate_series(floor(y0/2)::BIGINT, (ceil(y1/2)-1)::BIGINT)) AS j FROM t)
    SELECT id, i, j, round(greatest(i*2, x0),6)::DOUBLE AS tx0, round(least(i*2+2, x1),6)::DOUBLE AS tx1, round(greatest(j*2, y0),6)::DOUBLE AS ty0, round(least(j*2+2, y1),6)::DOUBLE AS ty1 FROM u"""
)
def tile_grid(spark, d):
    """Tiles of two degrees that meet each box, clipped to it."""
    k = F.col("n_nationkey")
    b = table(spark, d, "nation").select(k.alias("id"), (k * 1.5).alias("x0"), (k * 0.7).alias("y0"), (k * 1.5 + 5.2).alias("x1"), (k * 0.7 + 3.1).alias("y1"))
    for axis, name in (("x", "i"), ("y", "j")):
        b = b.withColumn(name, F.explode(F.sequence(F.floor(F.col(f"{axis}0") / 2), F.ceil(F.col(f"{axis}1") / 2) - 1)))
    return b.select("id", "i", "j", *(F.round(f(F.col(n) * 2 + a, F.col(e)), 6).cast("double").alias(f"t{e}") for n, a, e, f in (("i", 0, "x0", F.greatest), ("i", 2, "x1", F.least), ("j", 0, "y0", F.greatest), ("j", 2, "y1", F.least))))


@query(f"WITH {_G} SELECT count(*) AS n, round(sum(v),2) AS total FROM g WHERE x >= 5 AND x < 20 AND y >= 3 AND y < 9")
def bounds_filter(spark, d):
    inside = (F.col("x") >= 5) & (F.col("x") < 20) & (F.col("y") >= 3) & (F.col("y") < 9)
    return grid(spark, d).where(inside).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))
