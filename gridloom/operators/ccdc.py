"""Continuous change detection: harmonic models fitted to a pixel's series, broken where observations leave them.

The published method: clouds that a mask has missed are screened out of a model's first window by a robust fit; a model starts
only where the window is stable; its coefficients are a lasso by coordinate descent, with more waves as observations come;
single observations far off are dropped, and a run of them beyond a chi-square limit breaks the model.

Observations of a day are averaged first, so that a pixel's series, and with it a task's group, is bounded by the days it
covers, whatever the number of rows. Series are independent of each other: Spark deals the pixels, numpy fits each one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.harmonics import OMEGA
from ..sources.tables import staged

YEAR = 365.25
#: Probability beyond which a single observation is an outlier, and the robust screen's limit in deviations.
OUTLIER, SCREEN = 0.999999, 4.89
#: Observations from which two and three waves are fitted; those of the same season that judge new ones.
TWO, THREE, SEASON = 18, 24, 24
#: Growth of a segment after which it is fitted anew.
GROWTH = 1.33


@dataclass(frozen=True)
class Options:
    """``breakpoint_bands`` decide on breaks and ``screen_bands`` (two, or none) on outliers of the first window; ``penalty`` is the
    lasso's (0: least squares); ``date_format`` tells the unit of dates and models: 0 days, 1 fractional years, 2 milliseconds."""

    breakpoint_bands: Sequence[str] | None = None
    screen_bands: Sequence[str] = ()
    min_observations: int = 6
    probability: float = 0.99
    min_years: float = 1.33
    penalty: float = 20.0
    max_iterations: int = 25_000
    date_format: int = 0


def chi_square_limit(probability: float, bands: int) -> float:
    """The quantile of a chi-square distribution (cube-root normal approximation; one band exactly)."""
    if bands == 1:
        return NormalDist().inv_cdf((1 + probability) / 2) ** 2
    z = NormalDist().inv_cdf(probability)
    return bands * (1 - 2 / (9 * bands) + z * math.sqrt(2 / (9 * bands))) ** 3


def design(t: np.ndarray, waves: int) -> np.ndarray:
    w = OMEGA["day"]
    return np.stack([np.ones_like(t), t, *(f(k * w * t) for k in range(1, waves + 1) for f in (np.cos, np.sin))], axis=1)


def _by_signs(gram: np.ndarray, right: np.ndarray, penalty: float, tries: int = 60) -> np.ndarray | None:
    """The minimum of each column: solved for supposed signs, which change one by one, each time to a smaller sum, until the solution
    has them; None if that does not come about."""
    try:
        plain = np.linalg.solve(gram, right)
        sign = np.sign(plain)
        out = np.linalg.solve(gram, right - penalty * sign)
        for k in np.flatnonzero(~(sign * out > 0).all(0)):  # where some coefficients are to be 0
            s, c = sign[:, k], plain[:, k].copy()
            for _ in range(tries):
                on = np.flatnonzero(s)
                goal = np.zeros(len(gram))
                goal[on] = np.linalg.solve(gram[on][:, on], right[on, k] - penalty * s[on])
                crossed = np.flatnonzero((s != 0) & (s * goal <= 0))
                if len(crossed):  # as far as the first one that comes to 0
                    share = c[crossed] / (c[crossed] - goal[crossed])
                    at = np.argmin(share)
                    c += share[at] * (goal - c)
                    c[crossed[at]] = s[crossed[at]] = 0
                    continue
                c = goal
                slope = np.where(s == 0, right[:, k] - gram @ c, 0)
                most = np.argmax(np.abs(slope))
                if abs(slope[most]) <= penalty * (1 + 1e-12):
                    break
                s[most] = np.sign(slope[most])
            else:
                return None
            out[:, k] = c
    except np.linalg.LinAlgError:
        return None
    return out if np.isfinite(out).all() else None


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, max_iterations: int) -> np.ndarray:
    """Minimum of |y - x b|^2 / 2n + penalty |b| for each column of y; the first column of x, ones, is free.

    It is solved for the signs of the coefficients where they are found in a few steps, else by coordinate descent.
    """
    if penalty <= 0:
        return np.linalg.lstsq(x, y, rcond=None)[0]
    mean_x, mean_y = x[:, 1:].mean(0), y.mean(0)
    a, b = x[:, 1:] - mean_x, y - mean_y
    gram, right = a.T @ a / len(x), a.T @ b / len(x)
    out = _by_signs(gram, right, penalty)
    if out is not None:
        return np.vstack([mean_y - mean_x @ out, out])
    size = np.maximum(np.diag(gram), 1e-12)
    out = np.zeros((a.shape[1], y.shape[1]))
    enough = 1e-9 * np.sqrt((b**2).mean(0) + 1e-30)
    for _ in range(max_iterations):
        moved = np.zeros(y.shape[1])
        for j in range(len(out)):
            rho = right[j] - gram[j] @ out + gram[j, j] * out[j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - penalty, 0) / size[j]
            moved = np.maximum(moved, np.abs(new - out[j]) * math.sqrt(size[j]))
            out[j] = new
        if (moved <= enough).all():
            break
    return np.vstack([mean_y - mean_x @ out, out])


def screened(t: np.ndarray, y: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Which observations a robust fit (iteratively reweighted, bisquare) of a year's wave and one of the whole span leaves far off."""
    w, years = OMEGA["day"], max(math.ceil((t[-1] - t[0]) / YEAR), 1)
    x = np.stack([np.ones_like(t), np.cos(w * t), np.sin(w * t), np.cos(w * t / years), np.sin(w * t / years)], axis=1)
    off = np.zeros(len(t), bool)
    for k in range(y.shape[1]):
        weight = np.ones(len(t))
        for _ in range(5):
            root = np.sqrt(weight)
            rest = y[:, k] - x @ np.linalg.lstsq(x * root[:, None], y[:, k] * root, rcond=None)[0]
            scale = np.median(np.abs(rest)) / 0.6745
            if scale < 1e-12:
                break
            u = rest / (4.685 * scale)
            weight = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0)
        off |= np.abs(rest) > SCREEN * spread[k]
    return off


class Series:
    """One pixel's observations ``t`` (days, ascending) and ``y`` (a column each band), and the search for its segments."""

    def __init__(self, t: np.ndarray, y: np.ndarray, options: Options, breaking: Sequence[int], screening: Sequence[int]):
        self.t, self.y, self.o, self.breaking, self.screening = t, y, options, list(breaking), list(screening)
        self.limit = chi_square_limit(options.probability, len(self.breaking))
        self.far = chi_square_limit(OUTLIER, len(self.breaking))
        steps = np.abs(np.diff(y, axis=0))
        #: What neighbours in time differ by: an error below it says nothing.
        self.spread = np.maximum(np.median(steps, axis=0) if len(steps) else np.ones(y.shape[1]), 1e-9)

    def drop(self, at: int) -> None:
        self.t, self.y = np.delete(self.t, at), np.delete(self.y, at, axis=0)

    def fit(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of time since the first observation (8 a band) and residuals."""
        n = b - a
        waves = 1 if n < TWO else 2 if n < THREE else 3
        x = design(self.t[a:b] - self.t[a], waves)
        c = lasso(x, self.y[a:b], self.o.penalty, self.o.max_iterations)
        out = np.zeros((8, self.y.shape[1]))
        out[: len(c)] = c
        return out, self.y[a:b] - x @ c

    def parted(self, at: slice, start: int, coefs: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each observation, its differences from a model and the model's errors there: those of the same season where there are many."""
        t = self.t[at]
        gone = self.y[at] - design(t - self.t[start], 3) @ coefs
        if len(rest) > SEASON:
            apart = np.abs((self.t[start : start + len(rest)] % YEAR)[None, :] - (t % YEAR)[:, None])
            apart = np.minimum(apart, YEAR - apart)
            most = np.partition(apart, SEASON - 1, axis=1)[:, SEASON - 1 : SEASON]
            near, even = apart < most, apart == most
            near |= even & (np.cumsum(even, axis=1) <= SEASON - near.sum(1, keepdims=True))  # of those equally apart, the earlier ones
            error = np.sqrt(near @ rest**2 / SEASON)
        else:
            error = np.broadcast_to(np.sqrt((rest**2).mean(0)), gone.shape)
        return gone[:, self.breaking], np.maximum(error, self.spread)[:, self.breaking]

    def first_window(self, at: int) -> int | None:
        """End of the shortest window from ``at`` with enough observations over enough years, without what the screen takes out."""
        m = self.o.min_observations
        while True:
            end = at + m
            while end < len(self.t) and self.t[end - 1] - self.t[at] < self.o.min_years * YEAR:
                end += 1
            if end > len(self.t) or self.t[end - 1] - self.t[at] < self.o.min_years * YEAR:
                return None
            off = screened(self.t[at:end], self.y[at:end][:, self.screening], self.spread[self.screening]) if self.screening else np.zeros(0, bool)
            if not off.any() or off.all():
                return end
            self.drop(at + np.flatnonzero(off))

    def stable(self, a: int, b: int, coefs: np.ndarray, rest: np.ndarray) -> bool:
        """Whether neither the trend over the window nor its first and last residual are beyond the limit."""
        error = np.maximum(np.sqrt((rest**2).mean(0)), self.spread)
        drift = np.abs(coefs[1]) * (self.t[b - 1] - self.t[a])
        worst = (drift + np.abs(rest[0]) + np.abs(rest[-1])) / (3 * error)
        return bool((worst[self.breaking] ** 2).sum() <= self.limit)

    def segments(self) -> list[dict]:
        """In time order. ``t_break`` is the first observation beyond; a series that ends in some of them has their share as probability."""
        out: list[dict] = []
        at = done = 0
        while (end := self.first_window(at)) is not None:
            coefs, rest = self.fit(at, end)
            if not self.stable(at, end, coefs, rest):
                at += 1
                continue
            window = at, end
            while at > done:  # back over what an unstable start has skipped
                gone, error = self.parted(slice(at - 1, at), at, coefs, rest)
                far = ((gone / error) ** 2).sum()
                if self.limit < far <= self.far:
                    break
                if far > self.far:
                    self.drop(at - 1)
                    end -= 1
                at -= 1
            if (at, end) != window:
                coefs, rest = self.fit(at, end)
            end, broken, probability, coefs, rest = self.grown(at, end, coefs, rest)
            row = {"t_start": self.t[at], "t_end": self.t[end - 1], "t_break": None, "num_obs": end - at, "change_prob": probability, "magnitude": np.zeros(self.y.shape[1])}
            if probability:
                ahead = slice(end, end + self.o.min_observations)
                row["magnitude"] = np.median(self.y[ahead] - design(self.t[ahead] - self.t[at], 3) @ coefs, axis=0)
            out.append(row | {"coefs": self.absolute(coefs, self.t[at]), "rmse": np.sqrt((rest**2).mean(0))})
            if not broken:
                break
            out[-1]["t_break"] = self.t[end]
            at = done = end
        return out

    def grown(self, at: int, end: int, coefs: np.ndarray, rest: np.ndarray) -> tuple[int, bool, float, np.ndarray, np.ndarray]:
        m, fitted = self.o.min_observations, end - at
        probability, broken = 0.0, False
        ahead = np.zeros(0)  # what follows ``end`` as the present model sees it, one by one its own distance
        while end < len(self.t):
            if not len(ahead):  # as many as the model may see before it is fitted anew, and the window after them
                n = max(math.ceil(GROWTH * fitted) - (end - at), 1)
                gone, error = self.parted(slice(end, end + n + m), at, coefs, rest)
                ahead = ((gone / error) ** 2).sum(1)
                last = end + n + m >= len(self.t)
            if ahead[0] > self.limit:
                if len(ahead) < m and not last:
                    ahead = ahead[:0]
                    continue
                far = ((gone[:m] / error[0]) ** 2).sum(1)
                if (far > self.limit).all():
                    # where the series ends in them it is not yet a break
                    probability, broken = (1.0, True) if len(far) == m else (len(far) / m, False)
                    break
                if ahead[0] > self.far:
                    self.drop(end)
                    gone, error, ahead = gone[1:], error[1:], ahead[1:]
                    continue
            end += 1
            gone, error, ahead = gone[1:], error[1:], ahead[1:]
            if end - at >= GROWTH * fitted:
                coefs, rest = self.fit(at, end)
                fitted = end - at
                ahead = ahead[:0]
        if end - at != fitted:
            coefs, rest = self.fit(at, end)
        return end, broken, probability, coefs, rest

    @staticmethod
    def absolute(coefs: np.ndarray, start: float) -> np.ndarray:
        """Coefficients of absolute time, in days, from those of time since ``start``."""
        out = coefs.copy()
        out[0] -= coefs[1] * start
        for k in (1, 2, 3):
            s, c = math.sin(k * OMEGA["day"] * start), math.cos(k * OMEGA["day"] * start)
            out[2 * k], out[2 * k + 1] = coefs[2 * k] * c - coefs[2 * k + 1] * s, coefs[2 * k] * s + coefs[2 * k + 1] * c
        return out


def fit_segments(obs: DataFrame, key: str, day: str, bands: Sequence[str], options: Options = Options()) -> DataFrame:
    """``(key, t_start, t_end, t_break, num_obs, change_prob)`` and, for each band, ``<band>_coefs, _rmse, _magnitude``.

    ``day`` is a number of days (since 1970 where another date format is wanted: dates and models are then given in it).
    Observations with a masked band, or without a day, are left out. Pixels whose series is too short or never stable have no row.
    """
    breaking = [bands.index(b) for b in (options.breakpoint_bands or bands)]
    screening = [bands.index(b) for b in options.screen_bands] if len(options.screen_bands) == 2 else []
    scale, offset = {0: (1.0, 0.0), 1: (1 / YEAR, 1970.0), 2: (86_400_000.0, 0.0)}[options.date_format]
    valid = " and ".join(f"`{c}` is not null" for c in (day, *bands))
    daily = obs.where(valid).groupBy(F.col(key).alias("pixel"), F.col(day).cast("double").alias("t")).agg(*(F.avg(b).alias(b) for b in bands))
    fields = [f"pixel {dict(daily.dtypes)['pixel']}", "t_start double", "t_end double", "t_break double", "num_obs long", "change_prob double"]
    fields += [f"{b}_{n}" for b in bands for n in ("coefs array<double>", "rmse double", "magnitude double")]
    names = [f.split(" ")[0] for f in fields]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        made = []
        for s in Series(rows["t"].to_numpy(), rows[list(bands)].to_numpy(float), options, breaking, screening).segments():
            c = s["coefs"].copy()
            c[1] /= scale
            c[0] -= c[1] * offset  # waves keep their phase: the offset is whole years
            row = {"pixel": rows["pixel"].iloc[0], "num_obs": s["num_obs"], "change_prob": s["change_prob"]}
            row |= {n: None if s[n] is None else s[n] * scale + offset for n in ("t_start", "t_end", "t_break")}
            for i, b in enumerate(bands):
                row |= {f"{b}_coefs": c[:, i].tolist(), f"{b}_rmse": float(s["rmse"][i]), f"{b}_magnitude": float(s["magnitude"][i])}
            made.append(row)
        return pd.DataFrame(made, columns=names)

    fitted = daily.groupBy("pixel").applyInPandas(run, ", ".join(fields)).withColumnRenamed("pixel", key)
    return staged(fitted, "segments")  # written once: what reads segments reads them several times
