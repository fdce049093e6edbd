"""Harmonic models: value, mean, phase and amplitude from a coefficient array [c0, c1, a1, b1, a2, b2, a3, b3]."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Angular frequency of a year, for time in days, in fractional years and in milliseconds.
OMEGA = {"day": 2 * math.pi / 365.25, "year": 2 * math.pi, "millisecond": 2 * math.pi / (365.25 * 86400 * 1000)}


def value(coefs: Column, t: Column, harmonics: int = 3, unit: str = "day") -> Column:
    out, w = coefs[0] + coefs[1] * t, OMEGA[unit]
    for k in range(1, harmonics + 1):
        out = out + coefs[2 * k] * F.cos(t * (k * w)) + coefs[2 * k + 1] * F.sin(t * (k * w))
    return out


def mean(coefs: Column, start: Column, end: Column, harmonics: int = 3, unit: str = "day") -> Column:
    """Mean of the model between two times, in closed form."""
    out, w = coefs[0] + coefs[1] * (start + end) / 2, OMEGA[unit]
    for k in range(1, harmonics + 1):
        wave = coefs[2 * k] * (F.sin(end * (k * w)) - F.sin(start * (k * w))) - coefs[2 * k + 1] * (F.cos(end * (k * w)) - F.cos(start * (k * w)))
        out = out + wave / ((end - start) * (k * w))
    return out


def phase(coefs: Column, k: int) -> Column:
    return F.atan2(coefs[2 * k], coefs[2 * k + 1])


def amplitude(coefs: Column, k: int) -> Column:
    return F.hypot(coefs[2 * k], coefs[2 * k + 1])
