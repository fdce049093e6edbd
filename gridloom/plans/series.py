"""Time series as segments, harmonics and phenology. A customer's orders of a year are a segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, harmonics
from ..operators import fitting
from ..operators import phenology as P
from ..operators import segments as S
from ..registry import query, table

_DAY = "date_diff('day', DATE '1992-01-01', o_orderdate::DATE)"
_SEG = f"""s AS (SELECT o_custkey AS pixel, min({_DAY})::DOUBLE AS t_start, max({_DAY})::DOUBLE AS t_end, max({_DAY})::DOUBLE + 1 AS t_break, stddev_pop(o_totalprice)/1000 + 1 AS rmse, (max(o_totalprice) - avg(o_totalprice))/1000 - 40 AS magnitude,
 [avg(o_totalprice)/1000, count(*)*0.01, max(o_totalprice)/90000, 0.5, min(o_totalprice)/9000, 0.25, 0.1, 0.2] AS coefs FROM orders GROUP BY o_custkey, year(o_orderdate) HAVING count(*) > 1)"""


def segments(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")))
    p = "o_totalprice"
    coefs = F.array(F.avg(p) / 1000, F.count("*") * 0.01, F.max(p) / 90000, F.lit(0.5), F.min(p) / 9000, F.lit(0.25), F.lit(0.1), F.lit(0.2))
    return (
        o.groupBy(F.col("o_custkey").alias("pixel"), F.year("o_orderdate").alias("y"))
        .agg(
            F.min("day").cast("double").alias("t_start"), F.max("day").cast("double").alias("t_end"), (F.max("day") + 1).cast("double").alias("t_break"),
            (F.stddev_pop(p) / 1000 + 1).alias("rmse"), ((F.max(p) - F.avg(p)) / 1000 - 40).alias("magnitude"), coefs.alias("coefs"), F.count("*").alias("_n"),
        )
        .where("_n > 1").drop("_n", "y")
    )


def _lookup(name: str, how: str, sql: str) -> None:
    def run(spark, d):
        seg = segments(spark, d)
        at = seg.select("pixel").distinct().select("pixel", F.explode(F.array(F.lit(900.0), F.lit(1500.0))).alias("t"))
        return S.lookup(seg, at, "pixel", how, ["t_start", "t_end"])

    run.__name__ = name
    query(f"WITH {_SEG}, q AS (SELECT pixel, t FROM (SELECT DISTINCT pixel FROM s), (VALUES (900.0::DOUBLE), (1500.0::DOUBLE)) v(t)), j AS (SELECT pixel, t, t_start, t_end FROM q JOIN s USING (pixel)) {sql}")(run)


_PICK = "SELECT pixel, t, {0}(t_start, t_start) FILTER (WHERE {1}) AS t_start, {0}(t_end, t_start) FILTER (WHERE {1}) AS t_end FROM j GROUP BY 1, 2"
_lookup("segment_mask", "mask", _PICK.format("min_by", "t_start <= t AND t <= t_end"))
_lookup("segment_previous", "previous", _PICK.format("max_by", "t_start <= t"))
_lookup("segment_next", "next", _PICK.format("min_by", "t_end > t"))
_lookup(
    "segment_closest", "closest",
    """, k AS (SELECT pixel, t, min(abs(t_end-t)) > min(abs(t_start-t)) AS nx, min_by(struct_pack(a := t_start, b := t_end), t_start) FILTER (WHERE t_end > t) AS n, max_by(struct_pack(a := t_start, b := t_end), t_start) FILTER (WHERE t_start <= t) AS p FROM j GROUP BY 1,2),
    m AS (SELECT pixel, t, coalesce(CASE WHEN nx THEN n ELSE p END, p, n) AS c FROM k) SELECT pixel, t, c.a AS t_start, c.b AS t_end FROM m""",
)


@query(
    f"""WITH {_SEG} SELECT pixel, t_start, round(coefs[1]+coefs[2]*1000+coefs[3]*cos(1000*{harmonics.OMEGA['day']!r})+coefs[4]*sin(1000*{harmonics.OMEGA['day']!r})+coefs[5]*cos(2000*{harmonics.OMEGA['day']!r})+coefs[6]*sin(2000*{harmonics.OMEGA['day']!r}),6) AS value,
    round(atan2(coefs[3], coefs[4]),6) AS phase, round(sqrt(coefs[3]*coefs[3]+coefs[4]*coefs[4]),6) AS amplitude FROM s"""
)
def harmonic_slice(spark, d):
    c = F.col("coefs")
    return segments(spark, d).select("pixel", "t_start", F.round(harmonics.value(c, F.lit(1000.0), 2), 6).alias("value"), F.round(harmonics.phase(c, 1), 6).alias("phase"), F.round(harmonics.amplitude(c, 1), 6).alias("amplitude"))


@query(
    f"""WITH {_SEG}, w AS (SELECT *, {harmonics.OMEGA['day']!r} AS w FROM s WHERE t_end > t_start) SELECT pixel, t_start, round(coefs[1]+coefs[2]*(t_start+t_end)/2+(coefs[3]*(sin(t_end*w)-sin(t_start*w))-coefs[4]*(cos(t_end*w)-cos(t_start*w)))/((t_end-t_start)*w),5) AS mean FROM w"""
)
def harmonic_mean(spark, d):
    rows = segments(spark, d).where("t_end > t_start")
    return rows.select("pixel", "t_start", F.round(harmonics.mean(F.col("coefs"), F.col("t_start"), F.col("t_end"), 1), 5).alias("mean"))


@query(
    f"""WITH {_SEG} SELECT pixel, round(sum(coefs[1]*(least(t_end,1600)-greatest(t_start,800)))/nullif(sum(least(t_end,1600)-greatest(t_start,800)),0),8) AS value FROM s WHERE t_start < 1600 AND t_end > 800 GROUP BY 1"""
)
def segment_range_mean(spark, d):
    return S.range_mean(segments(spark, d), "pixel", 800.0, 1600.0, F.col("coefs")[0]).withColumn("value", F.round("value", 8))


@query(
    f"""WITH {_SEG}, c AS (SELECT *, abs(magnitude)/nullif(rmse,0) AS conf FROM s WHERE t_break >= 500 AND t_break < 2000 AND magnitude > 0)
    SELECT pixel, t_break, round(magnitude,6) AS magnitude, round(conf,6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY abs(magnitude) DESC, t_break) AS r FROM c WHERE conf >= 0.2) WHERE r = 1"""
)
def pick_breakpoint(spark, d):
    out = S.breakpoint_of(segments(spark, d), "pixel", 500, 2000, "INCREASE", 0.2, "MAGNITUDE")
    return out.select("pixel", "t_break", F.round("magnitude", 6).alias("magnitude"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_SEG} SELECT pixel, t_start AS from_start, n AS to_start FROM (SELECT *, lead(t_start) OVER (PARTITION BY pixel ORDER BY t_start) AS n, lead(t_start,2) OVER (PARTITION BY pixel ORDER BY t_start) AS n2 FROM s) WHERE n2 IS NOT NULL")
def segment_transitions(spark, d):
    return S.transitions(segments(spark, d), "pixel", keep_last=False)


@query(
    f"""WITH {_SEG}, x AS (SELECT pixel, t_end AS a, coalesce(lead(t_start) OVER (PARTITION BY pixel ORDER BY t_start), 3000) AS b FROM s UNION ALL SELECT pixel, 0, min(t_start) FROM s GROUP BY 1)
    SELECT pixel, a::DOUBLE AS gap_start, b::DOUBLE AS gap_end FROM x WHERE b > a"""
)
def segment_gaps(spark, d):
    return S.gaps(segments(spark, d), "pixel", 0.0, 3000.0)


@query(
    f"""WITH {_SEG}, x AS (SELECT pixel, t_start, t_end, unnest(generate_series(floor(t_start/100)::BIGINT, greatest(floor(t_start/100), ceil(t_end/100)-1)::BIGINT)) AS interval FROM s)
    SELECT pixel, interval, greatest(t_start, interval*100.0)::DOUBLE AS t_start, least(t_end, (interval+1)*100.0)::DOUBLE AS t_end FROM x"""
)
def segment_fixed_intervals(spark, d):
    return S.fixed_intervals(segments(spark, d), "pixel", 100.0)


@query(f"WITH {_SEG}, x AS (SELECT *, unnest(generate_series(t_start::BIGINT, t_end::BIGINT)) AS t FROM s) SELECT pixel, t, round(coefs[1]+coefs[2]*t,8) AS value, round(coefs[1]+coefs[2]*t-rmse,8) AS low, round(coefs[1]+coefs[2]*t+rmse,8) AS high FROM x")
def segment_daily(spark, d):
    rows = S.daily(segments(spark, d), "pixel", harmonics.value(F.col("coefs"), F.col("t"), 0), "rmse")
    return rows.select("pixel", "t", *(F.round(c, 8).alias(c) for c in ("value", "low", "high")))


@query(f"WITH {_SEG} SELECT pixel, min(t_start) AS first_start, max(t_start) AS last_start FROM s GROUP BY 1")
def segment_first_last(spark, d):
    out = S.first_last(segments(spark, d), "pixel", ["t_start", "t_end"])
    return out.select("pixel", F.col("first.t_start").alias("first_start"), F.col("last.t_start").alias("last_start"))


@query(
    """SELECT o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate)-1 + (hour(o_orderdate)*3600+minute(o_orderdate)*60+floor(second(o_orderdate)))/86400.0)/(CASE WHEN (year(o_orderdate)%4=0 AND year(o_orderdate)%100<>0) OR year(o_orderdate)%400=0 THEN 366 ELSE 365 END),8)::DOUBLE AS frac,
    (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719529)::BIGINT AS jday, least(abs(dayofyear(o_orderdate)-200), 365-abs(dayofyear(o_orderdate)-200))::BIGINT AS days,
    (dayofyear(o_orderdate) - CASE WHEN year(o_orderdate)%4=0 AND dayofyear(o_orderdate)>60 THEN 1 ELSE 0 END)::BIGINT AS doy FROM orders"""
)
def date_conversions(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(dates.fractional_year(t), 8).alias("frac"), F.floor(dates.julian_day(t)).alias("jday"), dates.circular_days(F.dayofyear(t), 200).cast("long").alias("days"), dates.day_of_year_no_leap(t).cast("long").alias("doy")
    )


@query(
    """WITH o AS (SELECT l_suppkey AS pixel, dayofyear(l_shipdate)::BIGINT AS doy, l_quantity AS v, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
    c AS (SELECT *, sum(v - m) OVER w AS cusum, row_number() OVER w AS i, count(*) OVER (PARTITION BY pixel) AS n FROM (SELECT *, avg(v) OVER (PARTITION BY pixel) AS m FROM o) WINDOW w AS (PARTITION BY pixel ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING))
    SELECT pixel, min_by(doy, (round(cusum,6), i)) AS node2, max_by(doy, (round(cusum,6), -i)) AS node4 FROM c WHERE i > 1 AND i < n GROUP BY 1"""
)
def phenology_nodes(spark, d):
    return P.nodes(_seasonal(spark, d), "pixel", "doy", "v", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


def _seasonal(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("pixel"), F.dayofyear("l_shipdate").cast("long").alias("doy"), F.col("l_quantity").alias("v"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT l_suppkey AS pixel, month(l_shipdate)::INTEGER AS month, round(median(l_quantity),4) AS v FROM lineitem GROUP BY 1, 2")
def phenology_monthly(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("pixel"), F.month("l_shipdate").alias("month")).agg(F.round(F.median("l_quantity"), 4).alias("v"))


@query("SELECT l_suppkey AS pixel, round(regr_slope(l_quantity, dayofyear(l_shipdate)),8) AS slope, round(regr_intercept(l_quantity, dayofyear(l_shipdate)),6) AS intercept FROM lineitem GROUP BY 1")
def linear_fit(spark, d):
    doy = F.dayofyear("l_shipdate")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pixel")).agg(F.round(F.regr_slope("l_quantity", doy), 8).alias("slope"), F.round(F.regr_intercept("l_quantity", doy), 6).alias("intercept"))


@query("SELECT user_id, ts, value FROM events WHERE user_id = 7")
def point_observations(spark, d):
    return table(spark, d, "events").where("user_id = 7").orderBy("ts").select("user_id", "ts", "value")


@query("SELECT l_suppkey AS pixel, round(median(l_quantity) FILTER (WHERE l_returnflag = 'A'),4) AS \"A\", round(median(l_quantity) FILTER (WHERE l_returnflag = 'N'),4) AS \"N\", round(median(l_quantity) FILTER (WHERE l_returnflag = 'R'),4) AS \"R\" FROM lineitem GROUP BY 1")
def time_series_export_pivot(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "pixel")
    return li.groupBy("pixel").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.median("l_quantity"), 4))


@query(
    f"""WITH {_SEG}, q AS (SELECT pixel, t FROM (SELECT DISTINCT pixel FROM s), (VALUES (900.0::DOUBLE), (1500.0::DOUBLE), (2900.0::DOUBLE)) v(t)), j AS (SELECT q.pixel, t, t_start, t_end, coefs[2] AS b, coefs[1] AS a FROM q JOIN s USING (pixel)),
    p AS (SELECT pixel, t, max_by(struct_pack(e := t_end, s := t_start, a := a, b := b), t_start) FILTER (WHERE t_start <= t) AS p, min_by(struct_pack(e := t_end, s := t_start, a := a, b := b), t_start) FILTER (WHERE t_end > t) AS n FROM j GROUP BY 1, 2)
    SELECT pixel, t, round(CASE WHEN p.e >= t THEN p.a + p.b*t WHEN p.e IS NOT NULL AND n.s > t THEN p.a+p.b*p.e + (t-p.e)/nullif(n.s-p.e,0)*(n.a+n.b*n.s - (p.a+p.b*p.e))
      WHEN coalesce(t - p.e, n.s - t) <= 400 THEN coalesce(p.a+p.b*p.e, n.a+n.b*n.s) END, 7) AS value FROM p"""
)
def segment_interpolation(spark, d):
    seg = segments(spark, d).select("pixel", "t_start", "t_end", F.col("coefs")[1].alias("slope"), F.col("coefs")[0].alias("offset"))
    at = seg.select("pixel").distinct().select("pixel", F.explode(F.array(F.lit(900.0), F.lit(1500.0), F.lit(2900.0))).alias("t"))
    return S.value_at(seg, at, "pixel", "slope", "offset", 400.0).withColumn("value", F.round("value", 7))


@query()
def radar_harmonics(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "pixel")
    return fitting.harmonic_regression(li, "pixel", dates.fractional_year(F.col("l_shipdate")) - 1970, "l_quantity")
