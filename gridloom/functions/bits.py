"""Bit fields and arithmetic on grid indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(value: Column, first: int, last: int | None = None) -> Column:
    """Bits ``first`` to ``last`` (inclusive; one bit if ``last`` is not given)."""
    width = (first if last is None else last) - first + 1
    return F.shiftright(value, first).bitwiseAND(F.lit((1 << width) - 1))


def parity(x: Column) -> Column:
    """0 or 1, also for negative indices."""
    return F.pmod(x, F.lit(2))


def cell_key(i: Column, j: Column) -> Column:
    """One 64-bit key of two grid indices."""
    return F.shiftleft(i.cast("long"), 32) + j.cast("long")
