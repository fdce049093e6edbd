"""Two-date change: class transitions with confidence, index differences with legends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_change(df: DataFrame, from_class: str, to_class: str, from_p: dict[int, str], to_p: dict[int, str], from_values: Sequence[int], to_values: Sequence[int], least: float) -> DataFrame:
    """``transition`` (1-based number of the pair of classes) and ``confidence`` of joined rows.

    Confidence is the mean of how much more probable each date's class is than in the other date. Below ``least``, both
    dates take the class that is more probable.
    """

    def probability(cls: Column, columns: dict[int, str]) -> Column:
        return F.coalesce(*(F.when(cls == v, F.col(c)) for v, c in columns.items()), F.lit(0.0))

    a, b = F.col(from_class), F.col(to_class)
    certain = (probability(b, to_p) - probability(a, to_p) + probability(a, from_p) - probability(b, from_p)) / 2
    likely = F.when(probability(b, to_p) > probability(a, from_p), b).otherwise(a)
    unsure = certain < least

    def place(cls: Column, values: Sequence[int]) -> Column:
        return F.array_position(F.array(*map(F.lit, values)), cls) - 1

    i, j = place(F.when(unsure, likely).otherwise(a), from_values), place(F.when(unsure, likely).otherwise(b), to_values)
    return df.withColumns({"transition": F.when((i >= 0) & (j >= 0), i * len(to_values) + j + 1), "confidence": certain})


def index_change(df: DataFrame, a: str, b: str, error_a: str, error_b: str) -> DataFrame:
    """Difference, normalised difference, ratio, error of the difference, and confidence (difference over error)."""
    d, total = F.col(b) - F.col(a), F.col(b) + F.col(a)
    error = F.sqrt(F.col(error_a) * F.col(error_a) + F.col(error_b) * F.col(error_b))
    return df.withColumns(
        {
            "difference": d,
            "normalized_difference": d / F.nullif(total, F.lit(0.0)),
            "ratio": F.col(b) / F.nullif(F.col(a), F.lit(0.0)),
            "error": error,
            "confidence": F.abs(d) / F.nullif(error, F.lit(0.0)),
        }
    )


def change_class(difference: Column, confidence: Column, least: float, legend: Sequence[tuple[int, float | None, float | None]]) -> Column:
    """The first legend entry whose half-open range holds the difference; an unsure difference counts as 0."""
    d = F.when(confidence <= least, F.lit(0.0)).otherwise(difference)
    out = None
    for value, low, high in legend:
        test = (F.lit(True) if low is None else d >= low) & (F.lit(True) if high is None else d < high)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out
