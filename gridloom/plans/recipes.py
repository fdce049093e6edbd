"""Recipes that refer to each other, structures of arrays, and geometry. Suppliers are pixels, customers are points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite as C
from ..operators import matching as M
from ..operators.recipes import Recipes, band_math
from ..registry import query, table


@query("WITH a AS (SELECT l_suppkey AS pixel, median(l_quantity) AS q, median(l_tax) AS t FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS pixel, max(l_discount) AS d FROM lineitem GROUP BY 1) SELECT pixel, round(q * 2 + d, 6) AS score, CASE WHEN t > 0.04 THEN 1 ELSE 0 END AS class FROM a JOIN b USING (pixel)")
def recipe_reference(spark, d):
    """A band-math recipe over a stack of two others, one of them used twice."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"), F.col("l_discount").alias("d"))
    recipes = Recipes({
        "median": lambda r: C.composite(li, ["pixel"], ["q", "t"], "MEDIAN"),
        "largest": lambda r: C.composite(li, ["pixel"], ["d"], "MAX"),
        "stack": lambda r: r["median"].join(r["largest"], "pixel"),
        "score": lambda r: band_math(r["stack"], ["pixel"], [("twice", lambda x: x["q"] * 2), ("score", lambda x: F.round(x["twice"] + x["d"], 6)), ("class", lambda x: F.when(x["t"] > 0.04, 1).otherwise(0))], {"score": "score", "class": "class"}),
    })
    return recipes["score"]


@query(
    """WITH l AS (SELECT o_custkey AS pixel, list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS a FROM orders GROUP BY 1)
    SELECT pixel, len(a)::INTEGER AS n, list_filter(a, lambda x: x > 100000) AS masked, a[1:3] AS head, a[len(a)] AS last, round(list_sum(a[1:2]), 4) AS two, list_concat(a[1:1], [0.0::DOUBLE]) AS padded,
    list_position(list_sort(a), a[1])::BIGINT AS place, list_sort(a)[1] AS least FROM l"""
)
def array_operations(spark, d):
    each = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice")))
    df = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("pixel")).agg(F.transform(each, lambda s: s["o_totalprice"]).alias("a"))
    a = F.col("a")
    return df.select(
        "pixel", F.size(a).alias("n"), F.filter(a, lambda x: x > 100000).alias("masked"), F.slice(a, 1, 3).alias("head"), F.element_at(a, -1).alias("last"), F.round(F.aggregate(F.slice(a, 1, 2), F.lit(0.0), lambda s, x: s + x), 4).alias("two"),
        F.concat(F.slice(a, 1, 1), F.array(F.lit(0.0))).alias("padded"), F.array_position(F.sort_array(a), a[0]).alias("place"), F.sort_array(a)[0].alias("least"),
    )


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 10 WHEN 'BUILDING' THEN 20 ELSE -1 END AS class, [0, 2, 4] AS steps, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END::BIGINT AS place FROM customer")
def dictionary_operations(spark, d):
    names, values = F.array(F.lit("AUTOMOBILE"), F.lit("BUILDING")), F.array(F.lit(10), F.lit(20))
    lookup = F.try_element_at(F.map_from_arrays(names, values), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(lookup, F.lit(-1)).alias("class"), F.sequence(F.lit(0), F.lit(4), F.lit(2)).alias("steps"), F.array_position(names, F.col("c_mktsegment")).alias("place"))


@query("SELECT o_orderstatus AS status, count(*)::DOUBLE AS total FROM orders GROUP BY 1")
def grouped_text_round_trip(spark, d):
    """Groups written as one text of ``{group=..., sum=...}`` parts and read back."""
    groups = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    part = F.concat(F.lit("{group="), F.col("o_orderstatus"), F.lit(", sum="), F.col("n").cast("double").cast("string"), F.lit("}"))
    text = groups.agg(F.concat(F.lit("["), F.array_join(F.collect_list(part), ", "), F.lit("]")).alias("text"))
    found = text.select(F.explode(F.regexp_extract_all("text", F.lit(r"\{[^}]*\}"), F.lit(0))).alias("part"))
    return found.select(F.regexp_extract("part", r"group=([^,}]*)", 1).alias("status"), F.regexp_extract("part", r"sum=([^,}]*)", 1).cast("double").alias("total"))


@query(
    """WITH s AS (SELECT quantile_cont(l_quantity, list_transform(range(21), lambda i: i / 20.0)) AS q FROM lineitem), t AS (SELECT quantile_cont(l_extendedprice, list_transform(range(21), lambda i: i / 20.0)) AS q FROM lineitem),
    r AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, least(greatest(len(list_filter(s.q, lambda x: x <= l_quantity)) - 1, 0), 19) AS i, s.q AS a, t.q AS b FROM lineitem, s, t)
    SELECT l_orderkey, l_linenumber, round(b[i + 1] + least(greatest(coalesce((v - a[i + 1]) / nullif(a[i + 2] - a[i + 1], 0), 0), 0), 1) * (b[i + 2] - b[i + 1]) + 1e-6, 4) AS matched FROM r"""
)
def histogram_matching(spark, d):
    li = table(spark, d, "lineitem")
    out = M.matched(li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v")), li.select(F.col("l_extendedprice").alias("v")), "v", 20)
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("matched") + 1e-6, 4).alias("matched"))


_BOX = "b AS (SELECT c_custkey AS scene, c_nationkey AS tile, c_acctbal / 100 AS x0, c_custkey % 90 AS y0, c_acctbal / 100 + 25 AS x1, c_custkey % 90 + 12.0 AS y1 FROM customer)"


def _boxes(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("scene"), F.col("c_nationkey").alias("tile"), (F.col("c_acctbal") / 100).alias("x0"), (F.col("c_custkey") % 90).cast("double").alias("y0"), (F.col("c_acctbal") / 100 + 25).alias("x1"), (F.col("c_custkey") % 90 + 12.0).alias("y1"))


@query(f"WITH {_BOX}, x AS (SELECT *, unnest(generate_series(floor(x0 / 10)::BIGINT, floor(x1 / 10)::BIGINT)) AS cx FROM b), y AS (SELECT *, unnest(generate_series(floor(y0 / 10)::BIGINT, floor(y1 / 10)::BIGINT)) AS cy FROM x) SELECT scene, cx, cy, (cx + 0.5) * 10 BETWEEN x0 AND x1 AND (cy + 0.5) * 10 BETWEEN y0 AND y1 AS inside FROM y")
def scene_cells(spark, d):
    return M.scene_cells(_boxes(spark, d), 10.0)


@query(f"WITH {_BOX} SELECT tile, min(x0) AS x0, min(y0)::DOUBLE AS y0, max(x1) AS x1, max(y1)::DOUBLE AS y1 FROM b GROUP BY 1")
def footprint_union(spark, d):
    return M.box_union(_boxes(spark, d), "tile")


@query(f"WITH {_BOX}, k AS (SELECT tile, max(x0) AS x0, max(y0)::DOUBLE AS y0, min(x1) AS x1, min(y1)::DOUBLE AS y1 FROM b GROUP BY 1) SELECT tile, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM (SELECT *, x0 <= x1 AND y0 <= y1 AS ok FROM k)")
def footprint_intersection(spark, d):
    return M.box_intersection(_boxes(spark, d), "tile")


@query("SELECT c_custkey, (x > 0 AND y > 0 AND x + y < 60) AS inside FROM (SELECT c_custkey, c_acctbal / 100 + 0.00123 AS x, c_custkey % 90 + 0.00456 AS y FROM customer)")
def points_in_polygon(spark, d):
    x, y = F.col("c_acctbal") / 100 + 0.00123, F.col("c_custkey") % 90 + 0.00456
    return table(spark, d, "customer").select("c_custkey", M.in_polygon(x, y, [(0.0, 0.0), (60.0, 0.0), (0.0, 60.0)]).alias("inside"))
