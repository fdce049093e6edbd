"""Recipes: named sub-queries that may use each other, and the calculations of a band-math recipe."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame


class Recipes:
    """Plans by name. A plan is a function of this object and yields a DataFrame; each is built once.

    A recipe that needs itself, directly or through others, raises instead of recursing without end.
    """

    def __init__(self, plans: Mapping[str, Callable[[Recipes], DataFrame]]):
        self.plans, self.made, self.open = dict(plans), {}, []

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.open:
            raise ValueError(" -> ".join([*self.open, name]) + ": a recipe refers to itself")
        if name not in self.plans:
            raise KeyError(f"no recipe {name}")
        if name not in self.made:
            self.open.append(name)
            try:
                self.made[name] = self.plans[name](self)
            finally:
                self.open.pop()
        return self.made[name]


def band_math(df: DataFrame, keys: Sequence[str], calculations: Sequence[tuple[str, Callable[[DataFrame], Column]]], outputs: Mapping[str, str]) -> DataFrame:
    """Ordered calculations, each of which may use the bands and the ones before, then keys and outputs under new names."""
    for name, formula in calculations:
        df = df.withColumn(name, formula(df))
    return df.select(*keys, *(df[c].alias(n) for c, n in outputs.items()))
