"""Verbs on bands: a frame's columns but its keys are its bands."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bands_of(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def first_row_columns(df: DataFrame, order: Sequence[str], properties: Sequence[str]) -> DataFrame:
    """``(name, place)``: names of the properties that the first row has, in alphabetical order; an empty table has none."""
    first = df.orderBy(*order).limit(1)
    names = F.filter(F.array(*(F.when(F.col(p).isNotNull(), F.lit(p)) for p in sorted(properties))), lambda n: n.isNotNull())
    return first.select(F.posexplode(names).alias("place", "name")).select("name", "place")


def select_bands(df: DataFrame, keys: Sequence[str], bands: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Keys and the given bands, each once (the first time it is named), renamed if ``names`` are given."""
    pairs = list(zip(bands, names or bands, strict=True))
    once = [(b, n) for i, (b, n) in enumerate(pairs) if n not in [m for _, m in pairs[:i]]]
    return df.select(*keys, *(F.col(b).alias(n) for b, n in once))


def exclude_bands(df: DataFrame, keys: Sequence[str], *patterns: str) -> DataFrame:
    """A band goes only if every pattern is found in its name; without patterns all stay."""
    gone = [b for b in bands_of(df, keys) if patterns and all(re.search(p, b) for p in patterns)]
    return df.drop(*gone)


def remove_bands(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    return df.drop(*bands)


def select_existing(df: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    return df.select(*keys, *(b for b in bands if b in df.columns))


def select_or_default(df: DataFrame, keys: Sequence[str], bands: Sequence[str], default=None) -> DataFrame:
    """The given bands; those that are not there hold ``default``."""
    return df.select(*keys, *(F.col(b) if b in df.columns else F.lit(default).cast("double").alias(b) for b in bands))


def update_bands(df: DataFrame, bands: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({b: f(F.col(b)) for b in bands if b in df.columns})


def add_bands(df: DataFrame, bands: Mapping[str, Column]) -> DataFrame:
    """Bands added, those that are there replaced."""
    return df.withColumns(dict(bands))


def common_bands(frames: Sequence[DataFrame], keys: Sequence[str]) -> list[str]:
    """Bands that all frames have, in the order of the first."""
    return [b for b in bands_of(frames[0], keys) if all(b in f.columns for f in frames[1:])]


def union_common(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows of all frames over their common bands."""
    bands = common_bands(frames, keys)
    out = frames[0].select(*keys, *bands)
    for f in frames[1:]:
        out = out.unionByName(f.select(*keys, *bands))
    return out
