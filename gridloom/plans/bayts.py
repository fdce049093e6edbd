"""Forest-loss alerts over events: users are pixels, a value is a pair of radar bands, and the first half of the time is history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayts as B
from ..registry import query, table
from ..streaming import bayts as S
from ..streaming import state

RULES = B.Rules(sensitivity=0.25, min_non_forest=0.55, high_confidence=0.9, low_confidence=0.7)

_PNF = "least(greatest({0}_c / nullif({0}_c + {0}_f, 0), 0.05), 0.95)"
_DENSITY = "exp(-pow(({0} - ({0}_mean - {1} * {0}_std)) / nullif(0.5 * {0}_std, 0), 2) / 2)"
_SEEN = f"""e AS (SELECT user_id AS pixel, event_id, floor(epoch(ts) / 86400)::BIGINT AS day, event_id % 2 + 1 AS orbit, value AS VV, value * 0.8 + event_id % 7 AS VH FROM events),
    mid AS (SELECT {{mid}} AS m), st AS (SELECT pixel, orbit, avg(VV) AS VV_mean, stddev_pop(VV) AS VV_std, avg(VH) AS VH_mean, stddev_pop(VH) AS VH_std FROM e, mid WHERE day < m GROUP BY 1, 2),
    dy AS (SELECT pixel, day, orbit, avg(VV) AS VV, avg(VH) AS VH FROM e, mid WHERE day >= m GROUP BY 1, 2, 3),
    de AS (SELECT dy.*, {', '.join(f"{_DENSITY.format(b, 1)} AS {b}_c, {_DENSITY.format(b, 0)} AS {b}_f" for b in ("VV", "VH"))} FROM dy JOIN st USING (pixel, orbit)),
    pr AS (SELECT pixel, day, orbit, 1970 + day / 365.25 AS date, {_PNF.format('VV')} AS vv, {_PNF.format('VH')} AS vh, pixel % 5 = 0 AS wet FROM de),
    o AS (SELECT *, greatest(vv, vh) AS both_, row_number() OVER (PARTITION BY pixel ORDER BY date, orbit) AS k FROM pr WHERE vv IS NOT NULL AND vh IS NOT NULL)"""
_MID = "(SELECT (min(floor(epoch(ts) / 86400)) + 12)::BIGINT FROM events)"
_FOLD = f"""r AS (SELECT pixel, 0::BIGINT AS k, 0.5::DOUBLE AS pnf, 0.0::DOUBLE AS p, 0 AS flag, 0::BIGINT AS by_, 0.0::DOUBLE AS first_, 0.0::DOUBLE AS sure_ FROM (SELECT DISTINCT pixel FROM o)
    UNION ALL SELECT pixel, k, q, np, nf, CASE WHEN nf = 0 THEN 0 WHEN nf <> flag THEN orbit ELSE by_ END, CASE WHEN nf = 0 THEN 0 WHEN nf <> flag AND nf = 1 THEN date ELSE first_ END, CASE WHEN nf = 0 THEN 0 WHEN nf <> flag AND nf = 2 THEN date ELSE sure_ END FROM (
      SELECT *, CASE WHEN flag = 1 AND same THEN CASE WHEN np < {RULES.min_change} THEN 0 WHEN np < {RULES.high_confidence} THEN 1 ELSE 2 END WHEN flag = 0 THEN CASE WHEN q < {RULES.min_non_forest} THEN 0 WHEN np < {RULES.high_confidence} THEN 1 ELSE 2 END ELSE flag END AS nf FROM (
        SELECT *, CASE WHEN flag = 1 AND NOT same THEN p WHEN flag = 0 AND q < {RULES.min_non_forest} THEN 0 ELSE prior * q / (prior * q + (1 - prior) * (1 - q)) END AS np FROM (
          SELECT *, by_ = 0 OR by_ = orbit OR q >= {RULES.min_non_forest} AS same, CASE WHEN flag = 0 THEN pnf ELSE p END AS prior FROM (
            SELECT o.pixel, o.k, o.date, o.orbit, CASE WHEN wet AND r.flag = 1 THEN vh ELSE both_ END AS q, r.pnf, r.p, CASE WHEN r.flag <> 2 AND (greatest(r.first_, r.sure_) - o.date) * 365 > 90 THEN 0 ELSE r.flag END AS flag, r.by_, r.first_, r.sure_
            FROM r JOIN o ON o.pixel = r.pixel AND o.k = r.k + 1)))))"""
_STATE = "round(pnf, 6) AS non_forest_probability, round(p, 6) AS change_probability, flag, by_::INT AS flag_orbit, round(first_, 6) AS first_detection_date, round(sure_, 6) AS confirmation_date"
_LAST = "(SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY k DESC) = 1)"
_ALL = f"WITH RECURSIVE {_SEEN.replace('{mid}', _MID)}, {_FOLD}"


def _events(spark, d):
    e = table(spark, d, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    return e.select(F.col("user_id").alias("pixel"), day.alias("day"), (F.col("event_id") % 2 + 1).alias("orbit"), F.col("value").alias("VV"), (F.col("value") * 0.8 + F.col("event_id") % 7).alias("VH"))


def _seen(spark, d):
    """Probabilities from the thirteenth day on, by the statistics of the days before."""
    e = _events(spark, d)
    e = e.join(F.broadcast(e.agg((F.min("day") + 12).alias("_m"))), how="cross")  # one row
    seen = B.probabilities(e.where("day >= _m"), B.orbit_statistics(e.where("day < _m"), "pixel", "orbit"), "pixel", "day", "orbit", RULES)
    return seen.select("pixel", "day", (F.lit(1970.0) + F.col("day") / 365.25).alias("date"), "orbit", "pnf", "vh_pnf", (F.col("pixel") % 5 == 0).alias("wetland"))


def _rounded(df, *more):
    return df.select("pixel", *(F.round(n, 6).alias(n) if n.endswith(("probability", "date")) else n for n in B.NAMES), *more)


@query(f"{_ALL} SELECT pixel, {_STATE} FROM {_LAST}")
def bayts_monitoring(spark, d):
    return _rounded(B.monitor(_seen(spark, d), "pixel", "date", "orbit", RULES, F.col("wetland")))


@query(f"{_ALL} SELECT pixel, {_STATE.replace('flag,', f'CASE WHEN flag > 0 AND p >= {RULES.low_confidence} THEN flag + 1 ELSE flag END AS flag,')} FROM {_LAST}")
def bayts_confidences(spark, d):
    return _rounded(B.alerts_of(B.monitor(_seen(spark, d), "pixel", "date", "orbit", RULES, F.col("wetland")), RULES))


@query(f"{_ALL} SELECT pixel, {_STATE} FROM {_LAST}")
def bayts_continued(spark, d):
    """Two runs, the second from the states of the first, end like one."""
    seen = _seen(spark, d)
    half = seen.join(F.broadcast(seen.agg(F.expr("percentile_approx(day, 0.5)").alias("_h"))), how="cross")  # one row
    first = B.monitor(half.where("day < _h"), "pixel", "date", "orbit", RULES, F.col("wetland"))
    return _rounded(B.monitor(half.where("day >= _h"), "pixel", "date", "orbit", RULES, F.col("wetland"), first))


@query(f"{_ALL} SELECT pixel, {_STATE}, 0::BIGINT AS late FROM {_LAST}")
def stream_bayts(spark, d):
    """The same as a stream of observations that continues from states: those of the first half are the initial ones."""
    seen = _seen(spark, d)
    half = seen.join(F.broadcast(seen.agg(F.expr("percentile_approx(day, 0.5)").alias("_h"))), how="cross")  # one row
    # a pixel's series lies in one file, so that it comes in one micro-batch, however many files there are
    rows = state.staged(half.repartition("pixel"), "bayts-seen")
    first = B.monitor(rows.where("day < _h"), "pixel", "date", "orbit", RULES, F.col("wetland"))
    stream = state.read_staged(rows).where("day >= _h")
    updated = state.run_now(S.monitored(stream, "pixel", RULES, first), ["pixel"], name="bayts")
    idle = first.join(updated.select("pixel"), "pixel", "left_anti").withColumn("late", F.lit(0).cast("long"))
    return _rounded(updated.unionByName(idle), "late")
