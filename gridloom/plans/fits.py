"""Models fitted to series and what is read from them. Suppliers and customers are pixels; segments are those of ``series``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, harmonics
from ..operators import alerts, ccdc, slices
from ..operators import phenology as P
from ..operators import segments as S
from ..operators.find import Find, classified, sampled
from ..registry import query, table
from .series import _SEG, segments


@query()
def ccdc_segments(spark, d):
    """Segments of every supplier's shipments; tested against series with planted breaks."""
    return _fitted(spark, d)


def _value(c: str, t: str, h: int) -> str:
    return f"({c}[1]+{c}[2]*{t}" + "".join(f"+{c}[{2 * k + 1}]*cos({t}*{k * harmonics.OMEGA['day']!r})+{c}[{2 * k + 2}]*sin({t}*{k * harmonics.OMEGA['day']!r})" for k in range(1, h + 1)) + ")"


@query(f"WITH {_SEG}, j AS (SELECT pixel, 1500.0::DOUBLE AS t, arg_max(s, t_start) FILTER (WHERE t_start <= 1500) AS x FROM s GROUP BY 1) SELECT pixel, t, round({_value('x.coefs', 't', 2)}, 6) AS value, round(x.magnitude, 6) AS magnitude, round(abs(x.magnitude) / x.rmse, 6) AS break_confidence, x.t_break AS t_break FROM j")
def ccdc_slice(spark, d):
    seg = segments(spark, d)
    at = seg.select("pixel").distinct().withColumn("t", F.lit(1500.0))
    out = S.slice_at(seg, at, "pixel", "previous", "coefs", 2)
    return out.select("pixel", "t", F.round("value", 6).alias("value"), F.round("magnitude", 6).alias("magnitude"), F.round("break_confidence", 6).alias("break_confidence"), "t_break")


def _mean(c: str, a: str, b: str) -> str:
    w = harmonics.OMEGA["day"]
    return f"({c}[1]+{c}[2]*({a}+{b})/2+({c}[3]*(sin({b}*{w!r})-sin({a}*{w!r}))-{c}[4]*(cos({b}*{w!r})-cos({a}*{w!r})))/(({b}-{a})*{w!r}))"


@query(
    f"""WITH {_SEG}, r AS (SELECT *, greatest(t_start, 800.0) AS lo, least(t_end, 1700.0) AS hi, t_end - t_start AS n FROM s WHERE t_start < 1700 AND t_end > 800), e AS (SELECT *, rmse / sqrt(greatest(n * (hi - lo) / (t_end - t_start), 1)) AS err FROM r WHERE hi > lo AND t_end > t_start)
    SELECT pixel, round(sum({_mean('coefs', 'lo', 'hi')} * (hi - lo)) / sum(hi - lo), 5) AS value, round(sum(err * (hi - lo)) / sum(hi - lo), 6) AS error FROM e GROUP BY 1"""
)
def ccdc_range_slice(spark, d):
    seg = segments(spark, d).where("t_end > t_start").withColumn("n", F.col("t_end") - F.col("t_start"))
    mean = harmonics.mean(F.col("coefs"), F.col("lo"), F.col("hi"), 1)
    return S.range_slice(seg, "pixel", 800.0, 1700.0, mean, "rmse", "n").select("pixel", F.round("value", 5).alias("value"), F.round("error", 6).alias("error"))


@query(f"WITH {_SEG} SELECT pixel, arg_min(t_start, (magnitude, t_start)) AS t_start, min(magnitude) AS magnitude FROM s GROUP BY 1")
def segment_least_magnitude(spark, d):
    return S.extreme(segments(spark, d), "pixel", "magnitude", "min", ["t_start", "magnitude"])


@query(f"WITH {_SEG} SELECT pixel, arg_min(t_start, (-rmse, t_start)) AS t_start, round(max(rmse), 6) AS rmse FROM s GROUP BY 1")
def segment_largest_error(spark, d):
    return S.extreme(segments(spark, d), "pixel", "rmse", "max", ["t_start", "rmse"]).select("pixel", "t_start", F.round("rmse", 6).alias("rmse"))


@query(f"WITH {_SEG}, j AS (SELECT pixel, min(t_start) FILTER (WHERE t_start <= 1500 AND 1500 < t_end) AS a, min(t_start) FILTER (WHERE t_end > 1500) AS b FROM s GROUP BY 1) SELECT pixel, 1500.0::DOUBLE AS t, coalesce(a, b) AS t_start FROM j")
def segment_clicked(spark, d):
    seg = segments(spark, d)
    return S.clicked(seg, seg.select("pixel").distinct().withColumn("t", F.lit(1500.0)), "pixel", ["t_start"])


@query(f"WITH {_SEG}, j AS (SELECT pixel, t_start, greatest(t_start - 1500, 1500 - t_end, 0) AS gap FROM s) SELECT pixel, 1500.0::DOUBLE AS t, arg_min(t_start, (gap, t_start)) AS t_start, min(gap) AS gap FROM j GROUP BY 1")
def segment_nearest(spark, d):
    seg = segments(spark, d)
    return S.nearest(seg, seg.select("pixel").distinct().withColumn("t", F.lit(1500.0)), "pixel", ["t_start"])


@query(
    f"""WITH {_SEG}, j AS (SELECT pixel, 1500.0::DOUBLE AS t, arg_max(s, t_start) FILTER (WHERE t_start <= 1500) AS p, arg_min(s, t_start) FILTER (WHERE t_end > 1500) AS n FROM s GROUP BY 1),
    k AS (SELECT *, (t - p.t_end) / nullif(n.t_start - p.t_end, 0) AS w, p.coefs[1] + p.coefs[2] * p.t_end AS a, n.coefs[1] + n.coefs[2] * n.t_start AS b, {_value('p.coefs', 't', 1)} - p.coefs[1] - p.coefs[2] * t AS wp, {_value('n.coefs', 't', 1)} - n.coefs[1] - n.coefs[2] * t AS wn FROM j)
    SELECT pixel, t, round(CASE WHEN p.t_end >= t THEN {_value('p.coefs', 't', 1)} WHEN p IS NOT NULL AND n IS NOT NULL THEN a + w * (b - a) + (1 - w) * wp + w * wn END, 5) AS value FROM k WHERE p IS NOT NULL OR n IS NOT NULL"""
)
def segment_blend(spark, d):
    seg = segments(spark, d)
    out = S.blended(seg, seg.select("pixel").distinct().withColumn("t", F.lit(1500.0)), "pixel", "coefs", 1)
    return out.select("pixel", "t", F.round("value", 5).alias("value"))


@query(f"WITH {_SEG} SELECT c_custkey AS pixel, coalesce(list(t_start ORDER BY t_start) FILTER (WHERE t_start IS NOT NULL), []) AS starts, coalesce(list(coalesce(t_break, 0) ORDER BY t_start) FILTER (WHERE t_start IS NOT NULL), []) AS breaks FROM customer LEFT JOIN s ON pixel = c_custkey GROUP BY 1")
def segments_at_points(spark, d):
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("pixel"))
    out = S.at_points(segments(spark, d), points, "pixel", {"t_start": "starts", "t_break": "breaks"})
    return out


@query(
    f"""WITH {_SEG}, o AS (SELECT o_custkey AS pixel, o_orderkey AS id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day, o_totalprice / 1000 AS v FROM orders),
    j AS (SELECT o.pixel, id, v, day - 365.25 AS t, arg_min(s, (greatest(t_start - day + 365.25, day - 365.25 - t_end, 0), t_start)) AS x FROM o JOIN s USING (pixel) GROUP BY ALL),
    k AS (SELECT pixel, id, {_value('x.coefs', 't', 1)} - v AS diff, x.rmse AS rmse FROM j) SELECT pixel, id, round(diff, 5) AS difference, round(abs(diff) / rmse, 5) AS confidence, abs(diff) / rmse > 1.5 AS changed FROM k"""
)
def change_alerts_year_before(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pixel"), F.col("o_orderkey").alias("id"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("day"), (F.col("o_totalprice") / 1000).alias("v"))
    out = alerts.year_before(o, segments(spark, d), "pixel", "day", "v", "coefs", "rmse", 1.5, 1)
    return out.select("pixel", "id", F.round("difference", 5).alias("difference"), F.round("confidence", 5).alias("confidence"), "changed")


_FOUND = f"WITH {_SEG}, f AS (SELECT pixel, t_start AS at0, CASE WHEN keep THEN t_start END AS t_start, CASE WHEN keep THEN days END AS days, CASE WHEN keep AND magnitude > -38 THEN magnitude END AS magnitude FROM (SELECT *, t_end - t_start AS days, t_end - t_start > 100 AS keep FROM s))"


def _find(spark, d):
    """Segments of more than a hundred days, with their length, and their magnitude where it is large enough."""
    f = Find(segments(spark, d).select("pixel", "t_start", "t_end", "magnitude"), "pixel").add_bands(days=F.col("t_end") - F.col("t_start"))
    return f.update_mask(F.col("days") > 100).add_bands(magnitude=F.when(F.col("magnitude") > -38, F.col("magnitude")))


def _picked(df):
    return df.select("pixel", "t_start", "days", F.round("magnitude", 6).alias("magnitude"))


@query(f"{_FOUND} SELECT pixel, " + ", ".join(f"{r}(arg_min({b}, at0) FILTER (WHERE {b} IS NOT NULL){x}) AS {b}" for b, r, x in (("t_start", "", ""), ("days", "", ""), ("magnitude", "round", ", 6"))) + " FROM f GROUP BY 1")
def segment_find_first(spark, d):
    return _picked(_find(spark, d).first())


@query(f"{_FOUND}, m AS (SELECT *, max(days) OVER (PARTITION BY pixel) AS best FROM f) SELECT pixel, " + ", ".join(f"{r}(arg_max({b}, at0) FILTER (WHERE {b} IS NOT NULL AND days = best){x}) AS {b}" for b, r, x in (("t_start", "", ""), ("days", "", ""), ("magnitude", "round", ", 6"))) + " FROM m GROUP BY 1")
def segment_find_longest(spark, d):
    return _picked(_find(spark, d).max("days"))


def _bands():
    c = F.col("coefs")
    return {"intercept": c[0], "slope": c[1], "amplitude": harmonics.amplitude(c, 1), "error": F.col("rmse")}


@query(
    f"""WITH {_SEG}, o AS (SELECT o_orderkey AS id, o_custkey AS pixel, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 20 AS day, o_orderstatus AS cls FROM orders),
    j AS (SELECT id, o.pixel, cls, arg_min(s, t_start) AS x FROM o JOIN s ON s.pixel = o.pixel AND t_start <= day AND day <= t_end GROUP BY ALL)
    SELECT id, pixel, cls, round(x.coefs[1], 9) AS intercept, round(x.coefs[2], 9) AS slope, round(sqrt(x.coefs[3] ** 2 + x.coefs[4] ** 2), 9) AS amplitude, round(x.rmse, 9) AS error FROM j"""
)
def segment_samples(spark, d):
    """Orders, three weeks on, as labelled points on their customer's segments."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) + 20
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("pixel"), day.alias("day"), F.col("o_orderstatus").alias("cls"))
    out = sampled(points, segments(spark, d), "pixel", "day", _bands())
    return out.select("id", "pixel", "cls", *(F.round(b, 9).alias(b) for b in _bands()))


@query()
def segment_classes(spark, d):
    """A tree trained on samples tells each segment's type; tested on segments that a threshold parts."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    points = table(spark, d, "orders").select(F.col("o_custkey").alias("pixel"), day.alias("day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("cls"))
    found = segments(spark, d)
    return classified(sampled(points, found, "pixel", "day", _bands()), found, _bands(), "cls", "CART").select("pixel", "t_start", "type")


_FRAMES = "WINDOW w AS (PARTITION BY pixel ORDER BY day, id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"


@query(
    f"""WITH {_SEG}, o AS (SELECT o_custkey AS pixel, o_orderkey AS id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice / 1000 END AS v FROM orders),
    j AS (SELECT o.pixel, id, day, v, day - 365.25 AS t, arg_max(s, t_start) FILTER (WHERE t_start <= day - 365.25) AS p, arg_min(s, t_end) FILTER (WHERE t_end > day - 365.25) AS n FROM o JOIN s USING (pixel) WHERE v IS NOT NULL GROUP BY ALL),
    x AS (SELECT *, CASE WHEN p IS NULL OR t - p.t_end > n.t_start - t THEN n ELSE p END AS x FROM j),
    k AS (SELECT pixel, id, day, {_value('x.coefs', 't', 3)} - v AS diff, abs({_value('x.coefs', 't', 3)} - v) / nullif(x.rmse, 0) AS sure FROM x WHERE p IS NOT NULL OR n IS NOT NULL),
    c AS (SELECT *, coalesce(sure > 1.2, false)::INT AS c FROM k),
    f AS (SELECT *, count(*) OVER w AS size, sum(c) OVER w AS ch, max(day) OVER w AS e, max(CASE WHEN c = 1 THEN day END) OVER w AS lc, min(CASE WHEN c = 1 THEN day END) OVER w AS fc, min(CASE WHEN c = 0 THEN day END) OVER w AS fs, max(CASE WHEN c = 0 THEN day END) OVER w AS ls FROM c {_FRAMES}),
    g AS (SELECT *, size = 4 AND 4 - ch >= 2 AS st, min(CASE WHEN size = 4 AND 4 - ch >= 2 THEN fs END) OVER (PARTITION BY pixel) AS fr FROM f), h AS (SELECT *, size = 4 AND ch >= 2 AS any_, size = 4 AND ch >= 2 AND e > fr AS cg FROM g),
    a AS (SELECT pixel, max(CASE WHEN st THEN ls END) AS last_stable, arg_min(fc, (day, id)) FILTER (WHERE cg) AS first_detection, arg_min(lc, (day, id)) FILTER (WHERE cg) AS confirmation, arg_min(lc, (day, id)) FILTER (WHERE any_) AS first_any, max(CASE WHEN cg THEN lc END) AS last_detection FROM h GROUP BY 1),
    m AS (SELECT * FROM a WHERE confirmation >= 1500 AND NOT coalesce(first_any <> confirmation, false) AND coalesce(last_stable < last_detection, true))
    SELECT q.pixel, coalesce(stable_at, 0) AS last_stable, round(coalesce(avg(sure) FILTER (WHERE day BETWEEN m.first_detection AND m.last_detection), 0), 6) AS confidence, round(coalesce(avg(diff) FILTER (WHERE day BETWEEN m.first_detection AND m.last_detection), 0), 6) AS difference,
    count(*) FILTER (WHERE day BETWEEN m.first_detection AND m.last_detection) AS detections, coalesce(any_value(m.first_detection), 0) AS first_detection, coalesce(any_value(m.confirmation), 0) AS confirmation, coalesce(any_value(m.last_detection), 0) AS last_detection,
    count(*) FILTER (WHERE day >= 1500) AS monitoring_observations, count(*) FILTER (WHERE day < 1500) AS calibration_observations
    FROM (SELECT DISTINCT pixel FROM s) q LEFT JOIN (SELECT pixel, last_stable AS stable_at FROM a) USING (pixel) LEFT JOIN c USING (pixel) LEFT JOIN m ON m.pixel = q.pixel GROUP BY q.pixel, stable_at"""
)
def segment_alerts(spark, d):
    """Alerts from start to end: models of a year before, frames of four, and what must be confirmed since day 1500 and stay."""
    v = F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice") / 1000)
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pixel"), F.col("o_orderkey").alias("id"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("day"), v.alias("v"))
    seg = segments(spark, d).withColumnsRenamed({"coefs": "v_coefs", "rmse": "v_rmse"})
    out = alerts.segment_alerts(o, seg, "pixel", ["day", "id"], "v", "v", 1500.0, 1.2, 4, 2)
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "difference")})


def _shipments(spark, d):
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), day.alias("day"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("b"))


def _fitted(spark, d):
    return ccdc.fit_segments(_shipments(spark, d), "pixel", "day", ["q", "b"], ccdc.Options(breakpoint_bands=["q"], screen_bands=["q", "b"], penalty=0.01))


@query()
def ccdc_slice_bands(spark, d):
    """Every band of the fitted segments on two days of every supplier; tested against plain Python."""
    at = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pixel"), F.explode(F.array(F.lit(900.0), F.lit(2100.0))).alias("t"))
    return slices.date_slice(_fitted(spark, d), at, "pixel", ["q", "b"], "EXTRAPOLATE", "CLOSEST", 90)


@query()
def ccdc_change_alerts(spark, d):
    """The last two years' shipments against models of the years before; tested piece by piece."""
    obs = _shipments(spark, d).withColumn("day", F.col("day").cast("double"))
    past = ccdc.fit_segments(obs.where("day < 1800"), "pixel", "day", ["q"], ccdc.Options(penalty=0.01))
    recent = obs.where("day >= 1800").groupBy("pixel", "day").agg(F.avg("q").alias("q"))
    return alerts.segment_alerts(recent, past, "pixel", ["day"], "q", "q", 2200.0, 1.0, 3, 2)


_IN = "CASE WHEN node{0} <= node{1} THEN d >= node{0} AND d < node{1} ELSE d >= node{0} OR d < node{1} END"


@query(
    f"""WITH o AS (SELECT l_suppkey AS pixel, dayofyear(l_shipdate)::INTEGER AS d, l_quantity AS v, l_shipdate AS ts, l_orderkey AS k, l_linenumber AS l FROM lineitem), m AS (SELECT pixel, avg(v) AS m, count(*) AS n FROM o GROUP BY 1),
    r AS (SELECT o.*, n, round(sum(v - m) OVER (PARTITION BY pixel ORDER BY ts, k, l ROWS UNBOUNDED PRECEDING), 6) AS c, row_number() OVER (PARTITION BY pixel ORDER BY ts, k, l) AS i FROM o JOIN m USING (pixel)),
    e AS (SELECT pixel, arg_min(d, (c, i)) AS node2, arg_max(d, (c, -i)) AS node4 FROM r WHERE i > 1 AND i < n GROUP BY 1),
    f AS (SELECT pixel, node2, node4, arg_max(d, (abs(c), -i)) FILTER (WHERE {_IN.format(4, 2)}) AS node1, arg_max(d, (abs(c), -i)) FILTER (WHERE {_IN.format(2, 4)}) AS node3 FROM r JOIN e USING (pixel) WHERE i > 1 AND i < n GROUP BY 1, 2, 3),
    g AS (SELECT pixel, node1, node2, node3, node4, {', '.join(f"median(v) FILTER (WHERE {_IN.format(i, i % 4 + 1)}) AS m{i}" for i in range(1, 5))}, coalesce(regr_slope(v, d) FILTER (WHERE {_IN.format(1, 2)}), 0) AS s1 FROM r JOIN f USING (pixel) GROUP BY 1, 2, 3, 4, 5)
    SELECT pixel, node1, node2, node3, node4, node2 - node1 + CASE WHEN node2 < node1 THEN 365 ELSE 0 END AS days_1, node1 - node4 + CASE WHEN node1 < node4 THEN 365 ELSE 0 END AS days_4, m1 AS median_1, m3 AS median_3, round(CASE WHEN isnan(s1) THEN 0 ELSE s1 END, 6) AS slope_1, least(m1, m2, m3, m4) AS background, round(greatest(m1, m2, m3, m4) - least(m1, m2, m3, m4), 6) AS amplitude FROM g"""
)
def phenology_cycle(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.dayofyear("l_shipdate").alias("doy"), F.col("l_quantity").alias("v"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber")
    out = P.cycle(li, "pixel", "doy", "v", ["ts", "l_orderkey", "l_linenumber"])
    return out.select("pixel", "node1", "node2", "node3", "node4", "days_1", "days_4", "median_1", "median_3", F.round("slope_1", 6).alias("slope_1"), "background", F.round("amplitude", 6).alias("amplitude"))


@query("SELECT l_suppkey AS pixel, " + ", ".join(f"median(l_quantity) FILTER (WHERE month(l_shipdate) = {m}) AS month_{m}" for m in range(1, 13)) + " FROM lineitem GROUP BY 1")
def monthly_medians(spark, d):
    return P.monthly_medians(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), "l_shipdate", "l_quantity"), "pixel", "l_shipdate", "l_quantity")


@query("SELECT event_id, CASE WHEN f = 1 AND p >= 0.85 THEN 2 WHEN f = 2 AND p >= 0.85 THEN 3 ELSE f END::BIGINT AS flag FROM (SELECT event_id, event_id % 3 AS f, (event_id % 100) / 100.0 AS p FROM events)")
def bayts_flags(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", alerts.bayesian_flags(e % 3, (e % 100) / 100.0).cast("long").alias("flag"))


@query(
    """WITH b AS (SELECT o_custkey AS pixel, arg_min(substr(o_orderpriority,1,1)::INT, (o_orderdate, o_orderkey)) AS base, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS bi FROM orders GROUP BY 1),
    o AS (SELECT o_custkey AS pixel, o_orderdate AS t, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE substr(o_orderpriority,1,1)::INT END AS cls, o_totalprice AS x FROM orders),
    r AS (SELECT *, coalesce(base IN (1, 2, 3) AND cls IN (4, 5) AND x - bi >= 1000, false) AS ch FROM o JOIN b USING (pixel)), f AS (SELECT pixel, min(t) FILTER (WHERE ch) AS t0, max(t) FILTER (WHERE ch) AS t1, count(*) AS images, count(cls) AS valid_images FROM r GROUP BY 1)
    SELECT pixel, t0 AS first_change, t1 AS last_change, images, valid_images, count_if(ch) AS changes, count_if(t >= t0 AND NOT ch AND cls IS NOT NULL) AS no_changes, count_if(t >= t0 AND cls IS NULL) AS occluded, count_if(t >= t0 AND cls IS NOT NULL) AS valid,
    round(min(x - bi) FILTER (WHERE ch), 4) AS least_move, round(max(x - bi) FILTER (WHERE ch), 4) AS largest_move, round(100 * count_if(ch) / count_if(t >= t0 AND cls IS NOT NULL), 4) AS repeatability FROM r JOIN f USING (pixel) WHERE t0 IS NOT NULL GROUP BY pixel, t0, t1, images, valid_images"""
)
def pyeo_alert_details(spark, d):
    cls = F.substring("o_orderpriority", 1, 1).cast("int")
    o = table(spark, d, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    base = o.groupBy(F.col("o_custkey").alias("pixel")).agg(F.min_by(cls, at).alias("base"), F.min_by("o_totalprice", at).alias("base_index"))
    obs = o.select(F.col("o_custkey").alias("pixel"), F.col("o_orderdate").alias("t"), F.when(F.col("o_orderkey") % 7 != 0, cls).alias("cls"), F.col("o_totalprice").alias("x"))
    out = alerts.class_alert_details(obs, "pixel", "t", "cls", "x", base, [1, 2, 3], [4, 5], 1000)
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("pixel", "first_change", "last_change", "images", "valid_images", "changes", "no_changes", "occluded", "valid", r("least_move"), r("largest_move"), r("repeatability"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS day, epoch_ms(o_orderdate) AS ms FROM orders")
def date_inverses(spark, d):
    o = table(spark, d, "orders").withColumn("t", F.date_trunc("day", "o_orderdate"))
    back = dates.from_fractional_year(dates.fractional_year(F.col("t")))
    same = F.when(back == dates.from_julian_day(dates.julian_day(F.col("t"))), back)
    return o.select("o_orderkey", same.cast("timestamp_ntz").alias("day"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))

