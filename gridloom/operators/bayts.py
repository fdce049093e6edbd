"""Bayesian alerts of forest loss in radar series: probabilities by orbit statistics, an ordered state machine, and alerts
continued from earlier ones.

State of a pixel: probability of non-forest of its last observation, probability of change, flag (0 none, 1 suspected, 2 confirmed;
3 confirmed by the earlier run that it was continued from), the orbit that flagged it, and the dates of detection and confirmation
(fractional years, 0 for none).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alerts import change_probability

STATE = "non_forest_probability double, change_probability double, flag int, flag_orbit int, first_detection_date double, confirmation_date double"
NAMES = [c.split()[0] for c in STATE.split(", ")]


@dataclass(frozen=True)
class Rules:
    sensitivity: float = 1.0
    max_days: float = 90
    min_non_forest: float = 0.6
    min_change: float = 0.5
    high_confidence: float = 0.975
    low_confidence: float = 0.85


def orbit_statistics(history: DataFrame, key: str, orbit: str, bands: tuple[str, str] = ("VV", "VH")) -> DataFrame:
    """Mean and deviation of each band of each pixel and orbit over a history."""
    return history.groupBy(key, orbit).agg(*(f(b).alias(f"{b}_{n}") for b in bands for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def probabilities(obs: DataFrame, statistics: DataFrame, key: str, date: str, orbit: str, rules: Rules = Rules()) -> DataFrame:
    """``(key, date, orbit, pnf, vh_pnf)``: the larger probability of both bands, and that of VH, by the statistics of the orbit.

    Observations of a day and orbit are one (their mean), so that a pixel's series is bounded by the days it covers. Those of
    pixels without statistics, or without spread in them, are masked.
    """
    daily = obs.groupBy(key, date, orbit).agg(F.avg("VV").alias("VV"), F.avg("VH").alias("VH")).join(statistics, [key, orbit])
    one = {b: change_probability(F.col(b), F.col(f"{b}_mean"), F.nullif(F.col(f"{b}_std"), F.lit(0.0)), rules.sensitivity) for b in ("VV", "VH")}
    rows = daily.select(key, date, orbit, one["VV"].alias("_vv"), one["VH"].alias("vh_pnf"), F.col("VV").isNotNull().alias("_v"), F.col("VH").isNotNull().alias("_h"))
    rows = rows.where("_v and _h and _vv is not null and vh_pnf is not null")
    return rows.select(key, date, orbit, F.greatest("_vv", "vh_pnf").alias("pnf"), "vh_pnf")


def step(rules: Rules = Rules()) -> str:
    """SQL of the state ``s`` after an observation ``x`` (date, orbit, pnf, vh_pnf, wetland)."""
    r = rules
    return f"""transform(array(named_struct('prev', if(s.flag <> 2 and (greatest(s.first_detection_date, s.confirmation_date) - x.date) * 365 > {r.max_days}, 0, s.flag),
        'pnf', if(x.wetland and s.flag = 1, x.vh_pnf, x.pnf))), a -> transform(array(named_struct('same', s.flag_orbit = 0 or s.flag_orbit = x.orbit or a.pnf >= {r.min_non_forest},
        'prior', if(a.prev = 0, s.non_forest_probability, s.change_probability))), b -> transform(array(
        case when a.prev = 1 and not b.same then s.change_probability when a.prev = 0 and a.pnf < {r.min_non_forest} then 0d
          else b.prior * a.pnf / (b.prior * a.pnf + (1 - b.prior) * (1 - a.pnf)) end), p -> transform(array(
        case when a.prev = 1 and b.same then if(p < {r.min_change}, 0, if(p < {r.high_confidence}, 1, 2))
          when a.prev = 0 then if(a.pnf < {r.min_non_forest}, 0, if(p < {r.high_confidence}, 1, 2)) else a.prev end), f ->
        named_struct('non_forest_probability', a.pnf, 'change_probability', p, 'flag', f, 'flag_orbit', if(f = 0, 0, if(f <> a.prev, x.orbit, s.flag_orbit)),
          'first_detection_date', if(f = 0, 0d, if(f <> a.prev and f = 1, x.date, s.first_detection_date)),
          'confirmation_date', if(f = 0, 0d, if(f <> a.prev and f = 2, x.date, s.confirmation_date))))[0])[0])[0])[0]"""


#: What a pixel starts from.
START = "named_struct('non_forest_probability', 0.5d, 'change_probability', 0d, 'flag', 0, 'flag_orbit', 0, 'first_detection_date', 0d, 'confirmation_date', 0d)"


def monitor(seen: DataFrame, key: str, date: str, orbit: str, rules: Rules = Rules(), wetland: Column | None = None, initial: DataFrame | None = None) -> DataFrame:
    """``(key, state)`` of every pixel of ``seen`` (of ``probabilities``) and of ``initial``, after its observations in order of date and orbit.

    ``initial`` holds states; pixels without one start anew, those without observations keep theirs. ``wetland``: pixels whose
    suspicion is judged by VH alone. A series is one row: it has two observations a day at most.
    """
    x = F.struct(F.col(date).cast("double").alias("date"), F.col(orbit).cast("int").alias("orbit"), "pnf", "vh_pnf", (F.lit(False) if wetland is None else F.coalesce(wetland, F.lit(False))).alias("wetland"))
    series = seen.groupBy(key).agg(F.array_sort(F.collect_list(x)).alias("series"))
    if initial is None:
        start = series.withColumn("start", F.expr(START))
    else:
        held = initial.select(F.col(key).alias("_k"), F.struct(*(F.col(n).cast(k).alias(n) for n, k in (c.split() for c in STATE.split(", ")))).alias("_s"))
        start = series.join(held, F.col(key) == F.col("_k"), "full").select(F.coalesce(F.col(key), F.col("_k")).alias(key), F.coalesce("series", F.array().cast(dict(series.dtypes)["series"])).alias("series"), F.coalesce("_s", F.expr(START)).alias("start"))
    return start.select(key, F.expr(f"aggregate(series, start, (s, x) -> {step(rules)})").alias("s")).select(key, *(F.col(f"s.{n}").alias(n) for n in NAMES))


def alerts_of(states: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """States as alerts: flag 1 low confidence, 2 high, 3 confirmed."""
    sure, f = F.col("change_probability") >= rules.low_confidence, F.col("flag")
    return states.withColumn("flag", F.when((f == 1) & sure, 2).when((f == 2) & sure, 3).otherwise(f))


def states_of(alerts: DataFrame) -> DataFrame:
    """States that a run continues from earlier alerts with: suspicions are taken up, what was confirmed stays so."""
    return alerts.withColumn("flag", F.when(F.col("flag") == 2, 1).otherwise(F.col("flag")))


def shown(alerts: DataFrame, start: float, include_confirmed: bool = True, least: int = 0) -> DataFrame:
    """Alerts as they are shown: without those confirmed before ``start`` if they are not to be included, and of ``least`` flag;
    the others have zeros."""
    keep = F.col("flag") >= least
    if not include_confirmed:
        keep = keep & ((F.col("confirmation_date") >= start) | (F.col("flag") != 3))
    return alerts.select(*(c for c in alerts.columns if c not in NAMES), *(F.when(keep, F.col(n)).otherwise(F.lit(0)).alias(n) for n in NAMES))
