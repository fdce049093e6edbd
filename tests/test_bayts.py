"""Forest-loss alerts: the SQL fold, the stream's state machine and runs that continue each other."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import bayts
from gridloom.streaming import bayts as stream
from gridloom.streaming import state

R = bayts.Rules()
START = (0.5, 0.0, 0, 0, 0.0, 0.0)


def observations(seed=3, pixels=12, n=30):
    rng = random.Random(seed)
    rows = []
    for p in range(pixels):
        for k in range(n):
            q = rng.choice([0.05, 0.3, 0.55, 0.62, 0.8, 0.95])
            rows.append((p, 2020 + k / 60, 1 + rng.randrange(2), q, rng.choice([q, 0.1, 0.7]), p % 3 == 0))
    return rows


def folded(rows, start=START):
    out = {}
    for p, date, orbit, q, v, wet in sorted(rows, key=lambda r: r[:3]):
        out[p] = stream.after(out.get(p, start), date, orbit, q, v, wet, R)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "pixel long, date double, orbit int, pnf double, vh_pnf double, wetland boolean")


def got(df):
    return {r.pixel: tuple(r[n] for n in bayts.NAMES) for r in df.collect()}


def near(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k]), k


def test_rules_one_by_one():
    suspected = stream.after(START, 2020.0, 1, 0.8, 0.8, False, R)
    assert suspected == pytest.approx((0.8, 0.8, 1, 1, 2020.0, 0.0))
    assert stream.after(START, 2020.0, 1, 0.59, 0.59, False, R)[1:4] == (0.0, 0, 0)
    # another orbit with a low probability changes nothing but the last probability
    assert stream.after(suspected, 2020.1, 2, 0.3, 0.3, False, R) == pytest.approx((0.3, 0.8, 1, 1, 2020.0, 0.0))
    # the same orbit takes the suspicion back, or confirms it
    assert stream.after(suspected, 2020.1, 1, 0.1, 0.1, False, R)[2:] == (0, 0, 0.0, 0.0)
    sure = stream.after(stream.after(suspected, 2020.1, 1, 0.95, 0.9, False, R), 2020.2, 2, 0.1, 0.1, False, R)
    assert sure[2:] == (2, 1, 2020.0, 2020.1)
    # a wetland's suspicion is judged by VH
    assert stream.after(suspected, 2020.1, 1, 0.95, 0.05, True, R)[2] == 0
    # what an earlier run has confirmed stays
    assert stream.after((0.9, 0.9, 3, 1, 2019.0, 2019.1), 2020.0, 1, 0.05, 0.05, False, R)[2:] == (3, 1, 2019.0, 2019.1)


def test_the_fold_equals_the_rules(spark):
    rows = observations()
    found = bayts.monitor(table(spark, rows), "pixel", "date", "orbit", R, F.col("wetland"))
    near(got(found), folded(rows))
    assert len({s[2] for s in got(found).values()}) > 1
    assert got(bayts.monitor(table(spark, []), "pixel", "date", "orbit", R)) == {}


def test_runs_continue_each_other(spark):
    rows = observations(5)
    first, second = [r for r in rows if r[1] < 2020.25], [r for r in rows if r[1] >= 2020.25 and r[0] != 4]
    of = lambda x, initial=None: bayts.monitor(table(spark, x), "pixel", "date", "orbit", R, F.col("wetland"), initial)
    near(got(of(second, of(first))), folded(first + second))
    alerts = bayts.alerts_of(of(first))
    kept = {r.pixel for r in alerts.where("flag = 3").collect()}
    again = bayts.alerts_of(of(second, bayts.states_of(alerts)))
    assert kept and kept <= {r.pixel for r in again.where("flag = 3").collect()}


def test_shown_alerts(spark):
    rows = [(1, 0.9, 0.9, 3, 1, 2020.0, 2020.1), (2, 0.9, 0.9, 3, 1, 2020.0, 2020.6), (3, 0.9, 0.9, 2, 1, 2020.0, 0.0), (4, 0.9, 0.6, 1, 1, 2020.0, 0.0)]
    alerts = spark.createDataFrame(rows, f"pixel long, {bayts.STATE}")
    flags = lambda **x: [r.flag for r in bayts.shown(alerts, 2020.5, **x).orderBy("pixel").collect()]
    assert flags() == [3, 3, 2, 1] and flags(include_confirmed=False) == [0, 3, 2, 1] and flags(least=2) == [3, 3, 2, 0] and flags(least=3, include_confirmed=False) == [0, 3, 0, 0]


def test_a_stream_in_several_batches_counts_late_rows(spark):
    rows = observations(7, 6)
    late = [(1, 2019.5, 1, 0.95, 0.95, False), (1, 2019.6, 1, 0.95, 0.95, False), (5, 2019.0, 2, 0.8, 0.8, False)]
    parts = [[r for r in rows if r[1] < 2020.2], [r for r in rows if 2020.2 <= r[1] < 2020.35], [r for r in rows if r[1] >= 2020.35] + late]
    import time

    first = state.staged(table(spark, parts[0]).coalesce(1), "bayts-test")
    for p in parts[1:]:
        time.sleep(1.1)  # files are read in order of their time
        table(spark, p).coalesce(1).write.mode("append").parquet(first._staged_at)
    initial = spark.createDataFrame([(5, 0.9, 0.9, 3, 1, 2018.0, 2018.1), (99, 0.4, 0.2, 1, 2, 2018.0, 0.0)], f"pixel long, {bayts.STATE}")
    out = state.run_now(stream.monitored(state.read_staged(first, files=1), "pixel", R, initial), ["pixel"], name="bayts-test")
    want = folded(rows)
    want[5] = folded([r for r in rows if r[0] == 5], (0.9, 0.9, 3, 1, 2018.0, 2018.1))[5]
    want[99] = None
    found = got(out)
    want = {k: v for k, v in want.items() if k in found}
    near(found, want)
    assert set(found) >= set(range(6))
    counted = {r.pixel: r.late for r in out.collect()}
    assert counted[1] == 2 and counted[5] == 1 and counted[0] == 0
