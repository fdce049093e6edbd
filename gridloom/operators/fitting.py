"""Models fitted to each pixel from sums: harmonic regression and unmixing. Sums are SQL; only small systems are solved in Python."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indexes

NAMES = ("constant", "t", "cos", "sin")


def harmonic_regression(obs: DataFrame, key: str, years: Column, value: str) -> DataFrame:
    """Coefficients of value on (1, t, cos 2 pi t, sin 2 pi t), phase, amplitude and rmse of each pixel.

    Each pixel is reduced to its fourteen sums of products before it is solved, so that long series cost no memory.
    Pixels with fewer observations than coefficients, or collinear ones, get the least-norm solution.
    """
    w = 2 * math.pi
    x = {"constant": F.lit(1.0), "t": years, "cos": F.cos(years * w), "sin": F.sin(years * w)}
    rows = obs.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_y"), *(c.cast("double").alias(f"_{n}") for n, c in x.items()))
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
    sums = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), *(F.sum(F.col(f"_{a}") * F.col("_y")).alias(f"y_{a}") for a in NAMES),
        *(F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias(f"{a}_{b}") for a, b in pairs),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.zeros((len(pdf), 4, 4))
            for a, b in pairs:
                i, j = NAMES.index(a), NAMES.index(b)
                m[:, i, j] = m[:, j, i] = pdf[f"{a}_{b}"]
            y = pdf[[f"y_{a}" for a in NAMES]].to_numpy()
            c = (np.linalg.pinv(m, hermitian=True) @ y[:, :, None])[:, :, 0] if len(pdf) else np.zeros((0, 4))
            left = np.maximum(pdf["yy"].to_numpy() - (c * y).sum(1), 0)
            out = pd.DataFrame({key: pdf[key], **{n: c[:, i] for i, n in enumerate(NAMES)}})
            yield out.assign(phase=np.arctan2(c[:, 3], c[:, 2]), amplitude=np.hypot(c[:, 2], c[:, 3]), rmse=np.sqrt(left / pdf["n"].to_numpy()))

    kind = dict(obs.dtypes)[key]
    return sums.mapInPandas(solve, f"{key} {kind}, " + ", ".join(f"{n} double" for n in (*NAMES, "phase", "amplitude", "rmse")))


def unmix(values: np.ndarray, endmembers: np.ndarray) -> np.ndarray:
    """Fractions (rows) of endmembers (rows) that are nearest to the values, not negative, with sum one.

    Five endmembers have 31 sets of positive fractions: each is solved for all rows at once and the best feasible kept.
    """
    k = len(endmembers)
    best, out = np.full(len(values), np.inf), np.zeros((len(values), k))
    for n in range(1, k + 1):
        for chosen in combinations(range(k), n):
            e = endmembers[list(chosen)]
            system = np.block([[e @ e.T, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
            right = np.concatenate([values @ e.T, np.ones((len(values), 1))], axis=1)
            part = (right @ np.linalg.pinv(system).T)[:, :n]
            error = ((part @ e - values) ** 2).sum(1)
            good = (part >= -1e-9).all(1) & (np.abs(part.sum(1) - 1) < 1e-6) & (error < best - 1e-12)
            best[good] = error[good]
            out[good] = 0
            out[np.ix_(good, list(chosen))] = np.maximum(part[good], 0)
    return out


def degradation_index(df: DataFrame, bands: Sequence[str] = indexes.BANDS) -> DataFrame:
    """``ndfi`` from the fractions of vegetation, shade, dead matter, soil and cloud; masked where a band is."""
    ends = np.array(list(indexes.ENDMEMBERS.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(bands)].to_numpy(float)
            known = ~np.isnan(x).any(1)
            f = np.full((len(pdf), 5), np.nan)
            f[known] = unmix(x[known], ends)
            gv, shade, npv, soil = f[:, 0], f[:, 1], f[:, 2], f[:, 3]
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(shade < 1, gv / (1 - shade), np.nan)
                value = np.where(g + npv + soil > 0, (g - (npv + soil)) / (g + npv + soil), np.nan)
            yield pdf.assign(ndfi=pd.Series(value, index=pdf.index).astype(object).where(~np.isnan(value), None))

    kinds = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, ndfi double")
