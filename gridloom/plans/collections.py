"""Observation collections: filters, masks, composites, zonal statistics. Line items are observations of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite as C
from ..operators import filters, zonal
from ..registry import query, table

TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def observations(spark: SparkSession, d: str, *more: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    return df.select(F.col("l_suppkey").alias("pixel"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_tax").alias("t"), F.col("l_discount").alias("disc"), *more)


@query(
    """SELECT l_suppkey AS pixel, round(median(l_quantity),4) AS q, round(median(CASE WHEN l_discount >= 0.03 THEN l_extendedprice END),4) AS p
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND (l_returnflag = 'R' OR l_returnflag = 'N') AND l_tax < 0.07
    GROUP BY 1"""
)
def asset_mosaic_median(spark, d):
    flags = {"property": "l_returnflag", "all": False, "constraints": [{"op": "=", "value": "R"}, {"op": "=", "value": "N"}]}
    tax = {"property": "t", "constraints": [{"op": "<", "value": 0.07}]}
    df = observations(spark, d, "l_returnflag").where((F.col("ts") >= "1996-01-01") & (F.col("ts") < "1998-01-01")).where(filters.property_filter([flags, tax]))
    df = filters.masked(df, ["p"], filters.pixel_mask([{"band": "disc", "constraints": [{"op": ">=", "value": 0.03}]}]))
    return C.composite(df, ["pixel"], ["q", "p"], "MEDIAN").select("pixel", F.round("q", 4).alias("q"), F.round("p", 4).alias("p"))


def _reducer(name: str, kind: str, sql: str) -> None:
    def run(spark, d):
        out = C.composite(observations(spark, d), ["pixel"], ["q", "p"], kind)
        return out if kind in ("COUNT", "MIN", "MAX") else out.select("pixel", F.round("q", 4).alias("q"), F.round("p", 4).alias("p"))

    run.__name__ = name
    query(f"SELECT l_suppkey AS pixel, {sql.format('l_quantity')} AS q, {sql.format('l_extendedprice')} AS p FROM lineitem GROUP BY 1")(run)


for _args in (
    ("composite_mean", "MEAN", "round(avg({}),4)"), ("composite_min", "MIN", "min({})"), ("composite_max", "MAX", "max({})"),
    ("composite_sd", "SD", "round(stddev_pop({}),4)"), ("time_series_count", "COUNT", "count({})"),
):
    _reducer(*_args)


@query("SELECT pixel, q FROM (SELECT l_suppkey AS pixel, cast(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, cast(l_quantity AS BIGINT)) AS r FROM lineitem GROUP BY l_suppkey, cast(l_quantity AS BIGINT)) WHERE r = 1")
def composite_mode(spark, d):
    return C.mode(observations(spark, d).select("pixel", F.col("q").cast("long").alias("q")), ["pixel"], "q")


@query("SELECT l_suppkey AS pixel, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS q FROM lineitem WHERE l_discount > 0.02 GROUP BY 1")
def composite_mosaic_last(spark, d):
    df = filters.masked(observations(spark, d, *TIE), ["q"], F.col("disc") > 0.02)
    return C.mosaic(df, ["pixel"], ["q"], ["ts", *TIE])


@query(
    """WITH o AS (SELECT label, vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
    m AS (SELECT label, median(a) AS ma, median(b) AS mb, median(c) AS mc FROM o GROUP BY 1),
    x AS (SELECT o.*, round(-sqrt(pow(a-ma,2)+pow(b-mb,2)+pow(c-mc,2)),9) AS qual FROM o JOIN m USING (label))
    SELECT label, vec_id, round(a,6) AS a FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY qual DESC, vec_id DESC) AS r FROM x) WHERE r = 1"""
)
def composite_medoid(spark, d):
    e = table(spark, d, "embeddings")
    df = e.select("label", "vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")))
    return C.medoid(df, ["label"], ["a", "b", "c"], ["vec_id"]).select("label", "vec_id", F.round("a", 6).alias("a"))


@query("SELECT pixel, vals AS q FROM (SELECT l_suppkey AS pixel, l_quantity AS vals, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1")
def quality_mosaic_price(spark, d):
    df = observations(spark, d, "l_orderkey", "l_linenumber", "l_partkey")
    return C.quality_mosaic(df, ["pixel"], "p", ["l_orderkey", "l_linenumber", "l_partkey"]).select("pixel", "q")


@query(
    """WITH l AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.8) AS lim FROM lineitem GROUP BY 1)
    SELECT l_suppkey AS pixel, count(*) AS n, round(sum(l_extendedprice),2) AS p FROM lineitem JOIN l USING (l_suppkey) WHERE l_quantity >= lim GROUP BY 1"""
)
def percentile_filter(spark, d):
    kept = C.percentile_mask(observations(spark, d), ["pixel"], "q", 80)
    return kept.groupBy("pixel").agg(F.count("*").alias("n"), F.round(F.sum("p"), 2).alias("p"))


@query(
    """WITH s AS (SELECT l_suppkey, median(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, median(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem GROUP BY 1)
    SELECT l_suppkey AS pixel, count(*) AS n FROM lineitem JOIN s USING (l_suppkey) WHERE abs(l_quantity-mq) <= 1.3*sq AND abs(l_extendedprice-mp) <= 1.3*sp GROUP BY 1"""
)
def radar_outlier_filter(spark, d):
    return C.outlier_mask(observations(spark, d), ["pixel"], ["q", "p"], 1.3).groupBy("pixel").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1) SELECT l_suppkey AS pixel, count(*) AS n FROM lineitem JOIN m USING (l_suppkey) WHERE l_extendedprice > 0.7*m GROUP BY 1")
def shadow_filter(spark, d):
    return C.above_median_share(observations(spark, d), ["pixel"], "p", 0.7).groupBy("pixel").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS pixel, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 32")
def min_observations(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pixel"))
    return C.enough_observations(df, ["pixel"], 32).groupBy("pixel").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2),
    b AS (SELECT l_suppkey, l_linenumber AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS r FROM c) WHERE r=1)
    SELECT l_suppkey AS pixel, best AS orbit, count(*) AS n, round(avg(l_quantity),6) AS q FROM lineitem JOIN b USING (l_suppkey) WHERE l_linenumber = best GROUP BY 1,2"""
)
def orbit_overlap(spark, d):
    df = observations(spark, d, F.col("l_linenumber").alias("orbit"))
    return C.preferred(df, ["pixel"], "orbit").groupBy("pixel", "orbit").agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("q"))


@query(
    """SELECT l_partkey AS pixel, count(*) AS n FROM (SELECT l_partkey, l_quantity > 20 AS f, min((l_quantity > 20)::INT) OVER (PARTITION BY l_partkey) AS a FROM lineitem) WHERE a = 1 OR NOT f GROUP BY 1"""
)
def mask_preventing_holes(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pixel"), (F.col("l_quantity") > 20).alias("flag"))
    return C.without_holes(df, ["pixel"], "flag").groupBy("pixel").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' OR event_type = 'view' GROUP BY 1")
def property_in_list(spark, d):
    e = table(spark, d, "events")
    return e.where(filters.in_list(e, "event_type", ["click", "view"])).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_size, count(*) AS n FROM part WHERE p_size = 8 OR p_size = 12 GROUP BY 1")
def property_equality(spark, d):
    p = table(spark, d, "part")
    return p.where(filters.equals(p, "p_size", "08") | filters.equals(p, "p_size", 12)).groupBy("p_size").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND (p_brand = 'Brand#11' OR p_retailprice > 1500)")
def property_constraints(spark, d):
    entries = [
        {"property": "p_size", "constraints": [{"op": "range", "low": 10, "high": 20}]},
        {"property": "p_partkey", "constraints": []},
    ]
    either = filters.constraint(F.col("p_brand"), "=", "Brand#11") | filters.constraint(F.col("p_retailprice"), ">", 1500)
    return table(spark, d, "part").where(filters.property_filter(entries) & either).select("p_partkey", "p_size")


@query("SELECT o_orderkey, CASE WHEN ((o_orderkey >> 3) & 3) >= 2 AND (o_orderkey & 1) = 0 THEN o_totalprice END AS price FROM orders")
def pixel_mask_bits(spark, d):
    mask = filters.pixel_mask([{"band": "o_orderkey", "constraints": [{"op": ">=", "value": 2, "from_bit": 3, "to_bit": 4}]}, {"band": "o_orderkey", "constraints": [{"op": "=", "value": 0, "from_bit": 0}]}])
    df = filters.masked(table(spark, d, "orders"), ["o_totalprice"], mask)
    return df.select("o_orderkey", F.col("o_totalprice").alias("price"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 100000 THEN 1 WHEN o_orderstatus IN ('F','O') THEN 2 WHEN o_totalprice >= 50000 AND o_totalprice < 90000 THEN 3 END AS class FROM orders")
def remapping(spark, d):
    rules = [
        {"value": 1, "constraints": [{"band": "o_orderpriority", "op": "=", "value": "1-URGENT"}, {"band": "o_totalprice", "op": ">", "value": 100000}]},
        {"value": 9, "constraints": []},
        {"value": 2, "constraints": [{"band": "o_orderstatus", "op": "class", "value": ["F", "O"]}]},
        {"value": 3, "constraints": [{"band": "o_totalprice", "op": "range", "low": 50000, "high": 90000}]},
    ]
    return table(spark, d, "orders").select("o_orderkey", filters.remap(rules).alias("class"))


@query("SELECT o.o_orderkey, CASE WHEN c.c_acctbal > 0 THEN o.o_totalprice END AS price FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def masking(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    df = o.join(c.select("c_custkey", "c_acctbal"), o["o_custkey"] == F.col("c_custkey"))
    return filters.masked(df, ["o_totalprice"], F.col("c_acctbal") > 0).select("o_orderkey", F.col("o_totalprice").alias("price"))


@query(
    """SELECT n_name AS stratum, round(sum(l_extendedprice),2) AS area, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"""
)
def area_per_stratum(spark, d):
    return zonal.area_per_stratum(_strata(spark, d), "stratum", "area")


def _strata(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("stratum"))
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("area"), F.col("l_discount").alias("probability"), F.col("l_linenumber").alias("class"))
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))


@query(
    """SELECT n_name AS stratum, round(CASE WHEN sum(l_extendedprice) > 0 THEN sum(l_discount*l_extendedprice)/sum(l_extendedprice) ELSE 0 END,8) AS proportion,
    round(CASE WHEN sum(l_extendedprice) > 0 THEN sum(CASE WHEN l_linenumber = 3 THEN l_extendedprice ELSE 0 END)/sum(l_extendedprice) ELSE 0 END,8) AS categorical
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"""
)
def weighted_area_proportions(spark, d):
    df = _strata(spark, d)
    a = zonal.weighted_proportion(df, "stratum", F.col("probability"), "area").select("stratum", F.round("proportion", 8).alias("proportion"))
    b = zonal.weighted_proportion(df, "stratum", (F.col("class") == 3).cast("double"), "area").select("stratum", F.round("proportion", 8).alias("categorical"))
    return a.join(b, "stratum")


@query("SELECT least(greatest(cast(floor((l_extendedprice - 0) / 5000) AS BIGINT), 0), 19) AS bucket, count(*) AS n FROM lineitem WHERE l_extendedprice >= 0 AND l_extendedprice < 100000 GROUP BY 1")
def fixed_histogram(spark, d):
    return zonal.fixed_histogram(table(spark, d, "lineitem"), "l_extendedprice", 0.0, 100000.0, 20)


@query("SELECT DISTINCT p_type AS value FROM part ORDER BY 1")
def distinct_values(spark, d):
    return zonal.distinct_values(table(spark, d, "part"), "p_type", 256)


@query("SELECT p_brand, p_size FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size > 25) ORDER BY p_size, p_brand")
def table_query(spark, d):
    return zonal.table_query(table(spark, d, "part"), where=F.col("p_size") > 25, distinct=["p_brand", "p_size"], sort=["p_brand", "p_size"], select=["p_brand", "p_size"])


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r > 50 AND r <= 100")
def table_page(spark, d):
    return zonal.page(table(spark, d, "customer"), "c_custkey", 50, 50).select("c_custkey", "c_name")


@query(
    """WITH h AS (SELECT cast(floor(l_extendedprice/1000) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT bucket, n, round(sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 10) AS cdf FROM h"""
)
def histogram_cdf(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 1000).alias("bucket")).agg(F.count("*").alias("n"))
    return zonal.cdf(h, "bucket", "n").select("bucket", "n", F.round("cdf", 10).alias("cdf"))


@query(
    """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT l_suppkey AS pixel, round(sum((l_extendedprice-lo)/(hi-lo)),6) AS s FROM lineitem, m GROUP BY 1"""
)
def minmax_normalize(spark, d):
    df = zonal.normalize(observations(spark, d), ["p"])
    return df.groupBy("pixel").agg(F.round(F.sum("p"), 6).alias("s"))


@query(
    """WITH b AS (SELECT l_suppkey AS pixel, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag='R' GROUP BY 1), c AS (SELECT l_suppkey AS pixel, avg(l_tax) AS t FROM lineitem WHERE l_returnflag='N' GROUP BY 1)
    SELECT coalesce(b.pixel, c.pixel) AS pixel, round(q,6) AS band_1, round(t,6) AS band_2 FROM b FULL JOIN c ON b.pixel=c.pixel"""
)
def stack(spark, d):
    o = observations(spark, d, "l_returnflag")
    a = C.composite(o.where("l_returnflag = 'R'"), ["pixel"], ["q"], "MEAN")
    b = C.composite(o.where("l_returnflag = 'N'"), ["pixel"], ["t"], "MEAN")
    return a.join(b, "pixel", "full").select("pixel", F.round("q", 6).alias("band_1"), F.round("t", 6).alias("band_2"))


@query(
    """WITH h AS (SELECT cast(floor(l_extendedprice/1000) AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT b, sum(n) OVER (ORDER BY b) / sum(n) OVER () AS lo, sum(n) OVER (ORDER BY b DESC) / sum(n) OVER () AS hi FROM h)
    SELECT coalesce(max(b) FILTER (WHERE lo < 0.02), min(b)) AS low, coalesce(min(b) FILTER (WHERE hi < 0.02), max(b)) AS high FROM c"""
)
def histogram_stretch(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 1000).alias("bucket")).agg(F.count("*").alias("n"))
    return zonal.stretch(h, "bucket", "n", 2)


@query(
    """WITH y AS (SELECT l_suppkey AS pixel, year(l_shipdate) AS y, median(l_quantity) AS m FROM lineitem WHERE year(l_shipdate) IN (1996,1997,1998,1999,2000) GROUP BY 1,2)
    SELECT pixel, coalesce(max(m) FILTER (WHERE y=1998), max(m) FILTER (WHERE y=1999), max(m) FILTER (WHERE y=1997), max(m) FILTER (WHERE y=2000), max(m) FILTER (WHERE y=1996)) AS q FROM y GROUP BY 1"""
)
def reference_composite(spark, d):
    """Median of the target year, or of the nearest year that has any; earlier years last of equally near ones."""
    o = observations(spark, d).withColumn("y", F.year("ts")).where(F.col("y").between(1996, 2000))
    years = o.groupBy("pixel", "y").agg(F.median("q").alias("m"))
    first = F.min_by("m", F.struct(F.abs(F.col("y") - 1998), -F.col("y")))
    return years.groupBy("pixel").agg(first.alias("q"))


@query(
    """WITH o AS (SELECT l_suppkey AS pixel, l_quantity AS q, l_extendedprice AS p FROM lineitem WHERE least(greatest((l_discount - 0)/(0.1 - 0),0),1) <= 0.5), m AS (SELECT pixel, median(p) AS b FROM o GROUP BY 1)
    SELECT pixel, median(q) AS q, count(*) AS n FROM o JOIN m USING (pixel) WHERE (b - p)/nullif(b + p,0) <= 0.4 GROUP BY 1"""
)
def planet_mosaic(spark, d):
    """Median of clear, unshaded observations: clouds by a scaled score, shadows by brightness against the median."""
    from ..functions import indexes

    o = observations(spark, d).where(indexes.scaled(F.col("disc"), 0.0, 0.1) <= 0.5)
    medians = o.groupBy("pixel").agg(F.median("p").alias("b"))
    clear = o.join(medians, "pixel").where(indexes.normalized(F.col("b"), F.col("p")) <= 0.4)
    return clear.groupBy("pixel").agg(F.median("q").alias("q"), F.count("*").alias("n"))
