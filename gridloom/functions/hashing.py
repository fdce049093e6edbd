"""Repeatable random numbers from keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of seed and keys; the same on every run and cluster."""
    text = F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
