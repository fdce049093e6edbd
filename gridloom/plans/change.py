"""Change detection between dates and along series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, change
from ..registry import query, table

_YEARS = """WITH a AS (SELECT o_custkey AS pixel, max_by(substr(o_orderpriority,1,1)::INT, (o_orderdate, o_orderkey)) AS c, count_if(o_orderpriority LIKE '1%')*1.0/count(*) AS p1, count_if(o_orderpriority LIKE '2%')*1.0/count(*) AS p2, count_if(o_orderpriority LIKE '3%')*1.0/count(*) AS p3 FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1),
 b AS (SELECT o_custkey AS pixel, max_by(substr(o_orderpriority,1,1)::INT, (o_orderdate, o_orderkey)) AS c, count_if(o_orderpriority LIKE '1%')*1.0/count(*) AS p1, count_if(o_orderpriority LIKE '2%')*1.0/count(*) AS p2, count_if(o_orderpriority LIKE '3%')*1.0/count(*) AS p3 FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1)"""


def _classes(spark, d, test: str, suffix: str):
    o = table(spark, d, "orders").where(test)
    cls = F.substring("o_orderpriority", 1, 1).cast("int")
    shares = [(F.count_if(F.col("o_orderpriority").startswith(str(k))) / F.count("*")).alias(f"p{k}_{suffix}") for k in (1, 2, 3)]
    return o.groupBy(F.col("o_custkey").alias("pixel")).agg(F.max_by(cls, F.struct("o_orderdate", "o_orderkey")).alias(f"c_{suffix}"), *shares)


@query(
    _YEARS
    + """, j AS (SELECT pixel, a.c AS ac, b.c AS bc, CASE b.c WHEN 1 THEN b.p1 WHEN 2 THEN b.p2 WHEN 3 THEN b.p3 ELSE 0 END AS bb, CASE a.c WHEN 1 THEN b.p1 WHEN 2 THEN b.p2 WHEN 3 THEN b.p3 ELSE 0 END AS ab,
      CASE a.c WHEN 1 THEN a.p1 WHEN 2 THEN a.p2 WHEN 3 THEN a.p3 ELSE 0 END AS aa, CASE b.c WHEN 1 THEN a.p1 WHEN 2 THEN a.p2 WHEN 3 THEN a.p3 ELSE 0 END AS ba FROM a JOIN b USING (pixel)),
    k AS (SELECT *, (bb - ab + aa - ba)/2 AS conf, CASE WHEN bb > aa THEN bc ELSE ac END AS likely FROM j),
    m AS (SELECT *, CASE WHEN conf < 0.1 THEN likely ELSE ac END AS fa, CASE WHEN conf < 0.1 THEN likely ELSE bc END AS fb FROM k)
    SELECT pixel, CASE WHEN fa BETWEEN 1 AND 5 AND fb BETWEEN 1 AND 5 THEN (fa-1)*5 + (fb-1) + 1 END::BIGINT AS transition, round(conf, 9)::DOUBLE AS confidence FROM m"""
)
def class_change(spark, d):
    rows = _classes(spark, d, "year(o_orderdate) < 1998", "a").join(_classes(spark, d, "year(o_orderdate) >= 1998", "b"), "pixel")
    out = change.class_change(rows, "c_a", "c_b", {k: f"p{k}_a" for k in (1, 2, 3)}, {k: f"p{k}_b" for k in (1, 2, 3)}, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5], 0.1)
    return out.select("pixel", "transition", F.round("confidence", 9).alias("confidence"))


@query(
    """WITH a AS (SELECT l_suppkey AS pixel, avg(l_quantity) AS a, stddev_pop(l_quantity)/sqrt(count(*)) AS ea FROM lineitem WHERE year(l_shipdate) < 1998 GROUP BY 1),
    b AS (SELECT l_suppkey AS pixel, avg(l_quantity) AS b, stddev_pop(l_quantity)/sqrt(count(*)) AS eb FROM lineitem WHERE year(l_shipdate) >= 1998 GROUP BY 1),
    j AS (SELECT pixel, b-a AS df, (b-a)/nullif(a+b,0) AS nd, b/nullif(a,0) AS ratio, sqrt(ea*ea+eb*eb) AS err FROM a JOIN b USING (pixel)),
    k AS (SELECT *, CASE WHEN abs(df)/nullif(err,0) <= 0.5 THEN 0 ELSE df END AS u FROM j)
    SELECT pixel, round(df,6) AS difference, round(nd,8) AS normalized_difference, round(ratio,8) AS ratio, round(err,6) AS error, round(abs(df)/nullif(err,0),6) AS confidence,
    CASE WHEN u < -0.5 THEN 1 WHEN u < 0.5 THEN 2 ELSE 3 END AS change FROM k"""
)
def index_change(spark, d):
    li = table(spark, d, "lineitem")
    make = lambda test, v, e: li.where(test).groupBy(F.col("l_suppkey").alias("pixel")).agg(F.avg("l_quantity").alias(v), (F.stddev_pop("l_quantity") / F.sqrt(F.count("*"))).alias(e))
    rows = make("year(l_shipdate) < 1998", "a", "ea").join(make("year(l_shipdate) >= 1998", "b", "eb"), "pixel")
    out = change.index_change(rows, "a", "b", "ea", "eb")
    legend = [(1, None, -0.5), (2, -0.5, 0.5), (3, 0.5, None)]
    out = out.withColumn("change", change.change_class(F.col("difference"), F.col("confidence"), 0.5, legend))
    return out.select("pixel", F.round("difference", 6).alias("difference"), F.round("normalized_difference", 8).alias("normalized_difference"), F.round("ratio", 8).alias("ratio"), F.round("error", 6).alias("error"), F.round("confidence", 6).alias("confidence"), "change")


_FRAME = "WINDOW w AS (PARTITION BY pixel ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"


@query(
    f"""WITH o AS (SELECT user_id AS pixel, ts, event_id, (value > 60)::INT AS c FROM events),
    f AS (SELECT *, count(*) OVER w AS size, sum(c) OVER w AS ch, max(ts) OVER w AS e, max(CASE WHEN c=1 THEN ts END) OVER w AS lc, min(CASE WHEN c=1 THEN ts END) OVER w AS fc, min(CASE WHEN c=0 THEN ts END) OVER w AS fs, max(CASE WHEN c=0 THEN ts END) OVER w AS ls FROM o {_FRAME}),
    g AS (SELECT *, size=3 AND 3-ch>=2 AS st, min(CASE WHEN size=3 AND 3-ch>=2 THEN fs END) OVER (PARTITION BY pixel) AS fr FROM f),
    h AS (SELECT *, size=3 AND ch>=2 AND e > fr AS cg FROM g),
    s AS (SELECT pixel, min(fr) AS first_stable, max(CASE WHEN st THEN ls END) AS last_stable, arg_min(fc, (ts,event_id)) FILTER (WHERE cg) AS first_detection, arg_min(lc, (ts,event_id)) FILTER (WHERE cg) AS confirmation, max(CASE WHEN cg THEN lc END) AS last_detection FROM h GROUP BY 1)
    SELECT s.*, (SELECT count(*) FROM o WHERE o.pixel = s.pixel AND o.ts BETWEEN first_detection AND last_detection) AS detections FROM s"""
)
def change_alerts(spark, d):
    obs = table(spark, d, "events").select(F.col("user_id").alias("pixel"), "ts", "event_id", "value")
    return alerts.framed_alerts(obs, "pixel", ["ts", "event_id"], F.col("value") > 60, 3, 2)


@query(
    """WITH cl AS (SELECT user_id AS pixel, ts, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 END AS c FROM events),
    b AS (SELECT pixel, arg_min(c, (ts,event_id)) AS base FROM cl WHERE c IS NOT NULL GROUP BY 1), r AS (SELECT *, coalesce(base IN (1,2) AND c IN (3,4), false) AS ch FROM cl JOIN b USING (pixel)),
    f AS (SELECT pixel, min(ts) AS first_change FROM r WHERE ch GROUP BY 1)
    SELECT pixel, first_change, count_if(ch)::BIGINT AS changes, count_if(NOT ch AND c IS NOT NULL)::BIGINT AS no_changes, count_if(c IS NULL)::BIGINT AS occluded, round(100.0*count_if(ch)/nullif(count_if(ch)+count_if(NOT ch AND c IS NOT NULL),0),6)::DOUBLE AS repeatability
    FROM r JOIN f USING (pixel) WHERE ts >= first_change GROUP BY 1,2"""
)
def pyeo_alerts(spark, d):
    cls = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4)
    obs = table(spark, d, "events").select(F.col("user_id").alias("pixel"), "ts", "event_id", cls.alias("c"))
    base = obs.where("c is not null").groupBy("pixel").agg(F.min_by("c", F.struct("ts", "event_id")).alias("base"))
    out = alerts.class_alerts(obs, "pixel", "ts", "c", base, [1, 2], [3, 4])
    return out.withColumn("repeatability", F.round("repeatability", 6))


_PNF = "least(greatest(exp(-pow((value-(50-40))/20,2)/2)/nullif(exp(-pow((value-(50-40))/20,2)/2)+exp(-pow((value-50)/20,2)/2),0),0.05),0.95)"


@query(
    f"""WITH RECURSIVE o AS (SELECT user_id AS pixel, ts, event_id, {_PNF} AS pnf, event_id % 2 + 1 AS orbit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT pixel, 0::BIGINT AS k, 0 AS flag, 0.0::DOUBLE AS p, 0.5::DOUBLE AS ppnf, 0::BIGINT AS porbit, NULL::TIMESTAMP AS since FROM (SELECT DISTINCT pixel FROM o)
      UNION ALL SELECT pixel, k, nf, np, pnf, CASE WHEN nf = 0 THEN 0 WHEN nf <> flag THEN orbit ELSE porbit END, CASE WHEN nf = 0 THEN NULL WHEN flag = 0 THEN ts ELSE since END FROM (
        SELECT *, CASE WHEN flag = 2 THEN 2 WHEN flag = 1 AND NOT same THEN 1 WHEN flag = 1 AND np < 0.5 THEN 0 WHEN flag = 1 AND np >= 0.975 THEN 2 WHEN flag = 1 THEN 1 WHEN pnf >= 0.6 AND np >= 0.975 THEN 2 WHEN pnf >= 0.6 THEN 1 ELSE 0 END AS nf FROM (
          SELECT *, CASE WHEN flag = 1 AND NOT same THEN p WHEN flag = 0 AND pnf < 0.6 THEN 0 ELSE prior*pnf/(prior*pnf+(1-prior)*(1-pnf)) END AS np FROM (
            SELECT o.pixel, o.k, o.ts, o.pnf, o.orbit, r.flag, r.p, r.porbit, r.since, (r.porbit = 0 OR r.porbit = o.orbit OR o.pnf >= 0.6) AS same, CASE WHEN r.flag = 0 THEN r.ppnf ELSE r.p END AS prior
            FROM r JOIN o ON o.pixel = r.pixel AND o.k = r.k + 1))))
    SELECT pixel, flag, round(p,6) AS p, since AS first_detection FROM (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY k DESC) AS q FROM r) WHERE q = 1"""
)
def bayts_alerts(spark, d):
    pnf = alerts.change_probability(F.col("value"), F.lit(50.0), F.lit(10.0))
    obs = table(spark, d, "events").select(F.col("user_id").alias("pixel"), "ts", "event_id", pnf.alias("pnf"), (F.col("event_id") % 2 + 1).alias("orbit"))
    return alerts.bayesian_alerts(obs, "pixel", ["ts", "event_id"], "pnf", "orbit").withColumn("p", F.round("p", 6))


@query(
    """SELECT l_suppkey AS pixel, round(avg(l_extendedprice) FILTER (WHERE l_linenumber % 2 = 0),4) AS mean_asc, round(stddev_pop(l_extendedprice) FILTER (WHERE l_linenumber % 2 = 0),4) AS std_asc,
    round(avg(l_extendedprice) FILTER (WHERE l_linenumber % 2 = 1),4) AS mean_desc, round(stddev_pop(l_extendedprice) FILTER (WHERE l_linenumber % 2 = 1),4) AS std_desc FROM lineitem GROUP BY 1"""
)
def bayts_historical(spark, d):
    asc = F.col("l_linenumber") % 2 == 0
    v = F.col("l_extendedprice")
    aggs = [F.round(f(F.when(t, v)), 4).alias(f"{n}_{s}") for s, t in (("asc", asc), ("desc", ~asc)) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pixel")).agg(*aggs)
