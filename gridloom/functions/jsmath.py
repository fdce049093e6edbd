"""The mathematical functions of scripted expressions where Spark's own differ, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTANTS = {
    "E": math.e, "LN10": math.log(10), "LN2": math.log(2), "LOG10E": math.log10(math.e), "LOG2E": math.log2(math.e), "PI": math.pi, "SQRT1_2": math.sqrt(0.5), "SQRT2": math.sqrt(2),
}


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def half_up(x: Column) -> Column:
    """Halves go up, below zero as well: -2.5 gives -2."""
    return F.floor(x + 0.5)


def fround(x: Column) -> Column:
    return x.cast("float").cast("double")


def int32(x: Column) -> Column:
    """The low 32 bits of a whole number, signed."""
    low = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def clz32(x: Column) -> Column:
    """Leading zero bits of a number's low 32 bits."""
    low = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low == 0, 32).otherwise(32 - F.length(F.bin(low)))


def imul(a: Column, b: Column) -> Column:
    """The product of two 32-bit numbers in 32 bits; the factors' halves keep the products within 64 bits."""
    x, y = int32(a), int32(b)
    low = y.bitwiseAND(F.lit(0xFFFF))
    return int32(x * low + F.shiftleft(int32(x * F.shiftright(y, 16)), 16))


def hypot(*xs: Column) -> Column:
    return F.sqrt(sum((x * x for x in xs), F.lit(0.0)))


def remainder(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend; null for a divisor of zero."""
    return a - b * trunc(a / F.nullif(b, F.lit(0.0)))
