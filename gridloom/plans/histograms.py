"""Adaptive histograms of prices and what is read off them; a table replaced in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import histogram as H
from ..registry import query, table
from ..sources import swap
from ..sources.tables import shared_folder

_BUCKETS = """e AS (SELECT {k} AS k, min({v})::DOUBLE AS a, max({v})::DOUBLE AS b FROM {t} GROUP BY 1), w0 AS (SELECT *, pow(2, ceil(log2((b - a) / {m}))) AS w FROM e),
    w AS (SELECT k, CASE WHEN floor(b / w) - floor(a / w) + 1 > {m} THEN 2 * w ELSE w END AS width FROM w0), h AS (SELECT w.k, floor({v} / width) * width AS start, width, count(*) AS n, avg({v}) AS mean FROM {t} JOIN w ON w.k = {k} GROUP BY ALL)"""
_ONE = _BUCKETS.format(k="0", v="o_totalprice", t="orders", m=256)
_ALL = _BUCKETS.format(k="l_suppkey", v="l_extendedprice", t="lineitem", m=16)


@query(f"WITH {_ONE} SELECT start, width, n, round(mean, 4) AS mean FROM h")
def auto_histogram(spark, d):
    return H.adaptive(table(spark, d, "orders"), "o_totalprice").select("start", "width", "n", F.round("mean", 4).alias("mean"))


@query(f"WITH {_ALL} SELECT k AS l_suppkey, start, width, n, round(mean, 4) AS mean FROM h")
def auto_histograms(spark, d):
    """One of 16 buckets for every supplier."""
    return H.adaptive(table(spark, d, "lineitem"), "l_extendedprice", ["l_suppkey"], 16).select("l_suppkey", "start", "width", "n", F.round("mean", 4).alias("mean"))


@query(
    f"""WITH {_ONE}, c AS (SELECT *, (sum(n) OVER (ORDER BY start) - n) / sum(n) OVER () AS below, n / sum(n) OVER () AS share FROM h), q AS (SELECT unnest([0.01, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS q)
    SELECT q AS share, round(arg_min(start + least((q - below) / share, 1) * width, start), 4) AS value FROM q JOIN c ON q >= below AND (q < below + share OR below + share >= 1 - 1e-12) GROUP BY q"""
)
def histogram_quantiles(spark, d):
    out = H.quantiles(H.adaptive(table(spark, d, "orders"), "o_totalprice"), [0.01, 0.25, 0.5, 0.9, 1.0])
    return out.select("share", F.round("value", 4).alias("value"))


@query(
    """WITH a AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_totalprice / 3 + 500 AS v FROM orders WHERE o_orderstatus <> 'F'),
    """ + ", ".join(
        f"{t}e AS (SELECT min(v)::DOUBLE AS x, max(v)::DOUBLE AS y FROM {t}), {t}0 AS (SELECT *, pow(2, ceil(log2((y - x) / 256))) AS w FROM {t}e), {t}w AS (SELECT CASE WHEN floor(y / w) - floor(x / w) + 1 > 256 THEN 2 * w ELSE w END AS w FROM {t}0), "
        f"{t}h AS (SELECT floor(v / w) * w AS start, w AS width, count(*) AS n FROM {t}, {t}w GROUP BY ALL), {t}c AS (SELECT start, width, (sum(n) OVER (ORDER BY start) - n) / sum(n) OVER () AS below, n / sum(n) OVER () AS share FROM {t}h)"
        for t in "ab"
    ) + """, r AS (SELECT id, v, below + least(greatest((v - start) / width, 0), 1) * share AS q FROM a ASOF JOIN ac ON v >= start)
    SELECT id, round(start + least((q - below) / share, 1) * width, 3) AS matched FROM r ASOF JOIN bc ON q >= below"""
)
def histogram_match_buckets(spark, d):
    """Finished orders' prices moved to the distribution of the others', by histograms of 256 buckets."""
    o = table(spark, d, "orders")
    a, b = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")), o.where("o_orderstatus <> 'F'").select((F.col("o_totalprice") / 3 + 500).alias("v"))
    return H.matched(a, "v", H.adaptive(a, "v"), H.adaptive(b, "v")).select("id", F.round("matched", 3).alias("matched"))


@query("SELECT o_orderkey, o_totalprice * 2 AS price, 2::BIGINT AS version FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderstatus = 'P'")
def table_swap(spark, d):
    """A table is written, then replaced by one made of itself; the second version is read."""
    o = table(spark, d, "orders")
    at = f"{shared_folder(spark)}/swap-{uuid.uuid4().hex}"
    swap.swap(o.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.lit(1).cast("long").alias("version")), at)
    first, newer = swap.current(spark, at), F.col("o_orderstatus") != "P"
    swap.swap(first.withColumns({"price": F.when(newer, F.col("price") * 2).otherwise(F.col("price")), "version": F.when(newer, 2).otherwise(F.col("version"))}), at)
    return swap.current(spark, at).select("o_orderkey", "price", "version")
