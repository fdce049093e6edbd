"""The segment fitter and slices through its segments, against plain Python."""

import math

import numpy as np
import pytest

from gridloom.operators import ccdc, slices

W = 2 * math.pi / 365.25


def series(breaks=(), outliers=(), years=8, step=16, start=0):
    rng = np.random.default_rng(5)
    t = np.arange(start, start + years * 365, step, dtype=float)
    y = 1000 + 300 * np.cos(W * t) + 100 * np.sin(2 * W * t) + rng.normal(0, 20, len(t))
    for at, size in breaks:
        y[t >= at] += size
    y[list(outliers)] += 2500
    return t, y


def found(t, y, **options):
    o = ccdc.Options(**{"penalty": 0.0} | options)
    return ccdc.Series(t, y[:, None], o, [0], [0] if o.screen_bands else []).segments()


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 1500, 60))
    x = ccdc.design(t - t[0], 3)
    y = np.stack([50 + 30 * np.cos(W * t) + rng.normal(0, 5, 60), rng.normal(0, 1, 60)], axis=1)
    for penalty in (0.5, 5.0):
        b = ccdc.lasso(x, y, penalty, 25_000)
        slope = x.T @ (y - x @ b) / len(t)
        assert np.abs(slope[0]).max() < 1e-6  # the constant is free
        held = np.abs(b[1:]) > 1e-12
        assert np.allclose(slope[1:][held], penalty * np.sign(b[1:][held]), atol=1e-3 * penalty)
        assert (np.abs(slope[1:][~held]) <= penalty * (1 + 1e-6)).all()
    assert np.allclose(ccdc.lasso(x, y, 0, 10), np.linalg.lstsq(x, y, rcond=None)[0])
    assert (ccdc.lasso(x, y, 1e6, 100)[1:] == 0).all()


def test_breaks_and_single_outliers():
    t, y = series(breaks=[(1200, 700)], outliers=[60, 130])
    first, last = found(t, y)
    assert 1200 <= first["t_break"] < 1216 and first["change_prob"] == 1 and abs(first["magnitude"][0] - 700) < 60
    assert last["t_start"] == first["t_break"] and last["t_break"] is None and last["change_prob"] == 0
    assert last["num_obs"] == (t >= 1200).sum() - 1  # the outlier is not counted: 60 lies before the break, 130 after it
    assert first["num_obs"] == (t < 1200).sum() - 1


def test_screen_takes_clouds_out_of_the_first_window():
    t, y = series(outliers=[2, 7])
    (screened,) = found(t, y, screen_bands=("v", "v"))
    assert screened["num_obs"] == len(t) - 2 and screened["t_start"] == t[0] and screened["rmse"][0] < 30
    plain = found(t, y)
    assert plain[0]["rmse"][0] > 30 or plain[0]["num_obs"] < len(t) - 2


def test_unstable_starts_are_left():
    t, y = series()
    y[:12] += np.linspace(3000, 0, 12)  # falls to the model in half a year
    segments = found(t, y)
    assert segments[-1]["t_start"] >= t[8] and segments[-1]["rmse"][0] < 40


def test_a_series_that_ends_beyond():
    t, y = series()
    y[-3:] += 800
    (only,) = found(t, y)
    assert only["change_prob"] == 0.5 and only["t_break"] is None and only["t_end"] == t[-4] and only["num_obs"] == len(t) - 3


def test_options_limit_the_start():
    t, y = series(years=2)
    assert len(found(t, y)) == 1 and found(t, y, min_years=3.0) == [] and found(t[:5], y[:5]) == []
    assert len(found(t, y, min_observations=len(t) + 1)) == 0


def test_no_wave_beside_a_strong_penalty():
    t, y = series()
    (only,) = found(t, y, penalty=1e5, probability=0.9999999)
    assert (only["coefs"][1:] == 0).all() and abs(only["coefs"][0, 0] - y.mean()) < 1e-6


@pytest.fixture(scope="module")
def segments(spark):
    rows = []
    for pixel, breaks in ((1, []), (2, [(1200, 700)])):
        t, y = series(breaks)
        rows += [(pixel, float(a), float(b), float(b) / 2) for a, b in zip(t, y)]
    rows += [(2, 600.0, None, 1.0), (3, 5.0, 1.0, 1.0), (4, None, 1.0, 1.0)]
    obs = spark.createDataFrame(rows, "pixel long, day double, v double, u double")
    return obs, ccdc.fit_segments(obs, "pixel", "day", ["v", "u"], ccdc.Options(breakpoint_bands=["v"], penalty=0)).cache()


def test_date_formats_tell_the_same_model(spark, segments):
    obs, days = segments
    for kind, unit, scale, offset in ((1, 2 * math.pi, 1 / 365.25, 1970.0), (2, W / 86_400_000, 86_400_000.0, 0.0)):
        other = ccdc.fit_segments(obs, "pixel", "day", ["v", "u"], ccdc.Options(breakpoint_bands=["v"], penalty=0, date_format=kind)).orderBy("pixel", "t_start").collect()
        for a, b in zip(days.orderBy("pixel", "t_start").collect(), other, strict=True):
            assert b.t_start == pytest.approx(a.t_start * scale + offset) and b.num_obs == a.num_obs and (a.t_break is None) == (b.t_break is None)
            value = lambda c, t, w: c[0] + c[1] * t + sum(c[2 * k] * math.cos(k * w * t) + c[2 * k + 1] * math.sin(k * w * t) for k in (1, 2, 3))
            at = a.t_start + 100
            assert value(b.v_coefs, at * scale + offset, unit) == pytest.approx(value(a.v_coefs, at, W), abs=1e-3)


def model(s, band, t, waves=3):
    c = s[f"{band}_coefs"]
    return c[0] + c[1] * t + sum(c[2 * k] * math.cos(k * W * t) + c[2 * k + 1] * math.sin(k * W * t) for k in range(1, waves + 1))


def test_slices_of_every_gap_strategy(spark, segments):
    """Two segments of pixel 2 with a gap cut between them; dates before, in, between and after; a pixel without segments."""
    _, found = segments
    from pyspark.sql import functions as F

    cut = found.withColumn("t_end", F.when(F.col("t_break").isNotNull(), F.col("t_end") - 300).otherwise(F.col("t_end")))
    rows = {p: sorted((r.asDict() for r in cut.where(f"pixel = {p}").collect()), key=lambda r: r["t_start"]) for p in (1, 2)}
    dates = [-50.0, 0.0, 500.0, rows[2][0]["t_end"], rows[2][0]["t_end"] + 40, rows[2][1]["t_start"] - 40, rows[2][1]["t_start"], rows[2][1]["t_end"] + 400]
    at = spark.createDataFrame([(p, t) for p in (1, 2, 9) for t in dates], "pixel long, t double")
    for gap, extrapolate, most in (("MASK", "CLOSEST", 0), ("EXTRAPOLATE", "CLOSEST", -1), ("EXTRAPOLATE", "CLOSEST", 45), ("EXTRAPOLATE", "PREVIOUS", -1), ("EXTRAPOLATE", "NEXT", 60), ("INTERPOLATE", "", 0)):
        got = {(r.pixel, r.t): r for r in slices.date_slice(cut, at, "pixel", ["v", "u"], gap, extrapolate, most).collect()}
        assert len(got) == 24
        for (p, t), r in got.items():
            own = rows.get(p, [])
            inside = next((s for s in reversed(own) if s["t_start"] <= t <= s["t_end"]), None)
            before = next((s for s in reversed(own) if s["t_start"] <= t), None)
            after = next((s for s in own if s["t_end"] > t), None)
            if gap == "INTERPOLATE":
                want = model(inside, "v", t) if inside else None
                if not inside and before and after:
                    w = (t - before["t_end"]) / (after["t_start"] - before["t_end"])
                    trend = lambda s, x: s["v_coefs"][0] + s["v_coefs"][1] * x
                    line = trend(before, before["t_end"]) * (1 - w) + trend(after, after["t_start"]) * w
                    want = line + (1 - w) * (model(before, "v", t) - trend(before, t)) + w * (model(after, "v", t) - trend(after, t))
                assert (r.v is None) == (want is None) and (want is None or r.v == pytest.approx(want))
                continue
            s = inside
            if not s and gap == "EXTRAPOLATE":
                pick = {"PREVIOUS": before, "NEXT": after}.get(extrapolate)
                if extrapolate == "CLOSEST":
                    pick = before if before and (not after or t - before["t_end"] <= after["t_start"] - t) else after
                s = pick
            if s is None:
                assert r.v is None and r.t_start is None
                continue
            away = max(s["t_start"] - t, t - s["t_end"], 0)
            assert r.t_start == s["t_start"] and r.num_obs == s["num_obs"] and r.v_rmse == s["v_rmse"]
            assert r.v == pytest.approx(model(s, "v", t)) if most < 0 or gap == "MASK" or away <= most else r.v is None
            assert r.u_slope == s["u_coefs"][1] and r.u_amplitude_2 == pytest.approx(math.hypot(*s["u_coefs"][4:6])) and r.u_phase_1 == pytest.approx(math.atan2(*s["u_coefs"][2:4]))
            assert r.v_breakConfidence == pytest.approx(s["v_magnitude"] / s["v_rmse"])
