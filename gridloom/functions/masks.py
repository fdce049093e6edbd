"""Mask algebra: a masked value is NULL, and an operation on a masked operand is masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def both(a: Column, b: Column) -> Column:
    """AND that is masked if either side is (SQL's would give false for false AND NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def either(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


def where(x: Column, test: Column, value) -> Column:
    """``x`` replaced by ``value`` where ``test`` holds; a masked test keeps ``x``, a masked ``x`` stays masked."""
    return F.when(x.isNull(), None).when(test, value).otherwise(x)


def unmask(x: Column, value) -> Column:
    return F.coalesce(x, F.lit(value))


def ratio(a: Column, b: Column) -> Column:
    """Division that masks where the divisor is zero."""
    return a / F.nullif(b, F.lit(0))


def mean_of(*values: Column) -> Column:
    """Mean of the values that are not masked; masked if all are."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return total / F.nullif(sum((v.isNotNull().cast("int") for v in values), F.lit(0)), F.lit(0))
