"""Dates as the numbers that time series use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day number of 1970-01-01 in the proleptic count that starts at year 0 (fixed value).
EPOCH_DAY = 719529


def _leap(t: Column) -> Column:
    y = F.year(t)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def seconds_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def fractional_year(t: Column) -> Column:
    return F.year(t) + (F.dayofyear(t) - 1 + seconds_of_day(t) / 86400) / F.when(_leap(t), 366).otherwise(365)


def julian_day(t: Column) -> Column:
    return F.datediff(t, F.lit("1970-01-01").cast("date")) + seconds_of_day(t) / 86400 + EPOCH_DAY


def day_of_year_no_leap(t: Column) -> Column:
    """Day of year in which days after 29 February of leap years count as in other years."""
    return F.dayofyear(t) - F.when(_leap(t) & (F.dayofyear(t) > 60), 1).otherwise(0)


def circular_days(a: Column, b) -> Column:
    """Distance of two days of year around the year's end."""
    d = F.abs(a - b)
    return F.least(d, 365 - d)


def in_season(doy: Column, start: int, end: int) -> Column:
    """Days of year from ``start`` to ``end``, over the year's end if it starts later than it ends."""
    return (doy >= start) & (doy <= end) if start < end else (doy >= start) | (doy <= end)


def seasonal(t: Column, start: str, end: str, years_before: int, years_after: int) -> Column:
    """``[start, end)`` in its own and neighbouring years.

    The years before are counted from one after (shifts -1 to years_before - 2 backwards), as users of such recipes
    expect from the original; years after from 1.
    """
    shifts = {0, *(-(i - 1) for i in range(years_before)), *range(1, years_after + 1)}
    out = F.lit(False)
    for s in sorted(shifts):
        lo, hi = (F.add_months(F.lit(x).cast("date"), 12 * s) for x in (start, end))
        out = out | ((t >= lo) & (t < hi))
    return out


def from_fractional_year(y: Column) -> Column:
    """The time of a fractional year, to the second."""
    year = F.floor(y).cast("int")
    first = F.make_date(year, F.lit(1), F.lit(1))
    length = F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), first)
    seconds = F.round((y - year) * length * 86400).cast("long")
    return F.timestamp_seconds(F.unix_seconds(first.cast("timestamp")) + seconds)


def from_julian_day(day: Column) -> Column:
    """The time of a day number that counts from year 0, to the second."""
    return F.timestamp_seconds(F.round((day - EPOCH_DAY) * 86400).cast("long"))


def two_months(t: Column, month: int) -> Column:
    """Dates of a month and the one after it; of December itself alone, as there is no month 13."""
    return F.month(t).isin(month, month + 1)


def monitoring(end: Column, monitoring_months: int, calibration_months: int) -> list[Column]:
    """``monitoring_end, monitoring_start, calibration_start`` from the end and the durations before it."""
    start = F.add_months(end, -monitoring_months)
    return [end.alias("monitoring_end"), start.alias("monitoring_start"), F.add_months(start, -calibration_months).alias("calibration_start")]
