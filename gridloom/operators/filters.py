"""Property filters, pixel masks and legends, declared as data and built into columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits


def equals(df: DataFrame, name: str, value) -> Column:
    """Equality with a value from a text box: a string that reads as a number also matches that number."""
    kind = dict(df.dtypes)[name]
    number = None
    if isinstance(value, str) and value.strip():
        try:
            number = float(value)
        except ValueError:
            number = None
    if kind == "string":
        raw = F.col(name) == F.lit(None if value is None else str(value) if not isinstance(value, bool) else str(value).lower())
        if isinstance(value, str):
            return raw
        return F.expr(f"try_cast(`{name}` as double)") == F.lit(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else raw
    if isinstance(value, bool) or value is None or (isinstance(value, str) and number is None):
        return F.col(name) == F.lit(value) if kind == "boolean" else F.lit(False)
    return F.col(name) == F.lit(number if isinstance(value, str) else value)


def in_list(df: DataFrame, name: str, values: Sequence) -> Column:
    """Equality with any value; no value matches nothing."""
    return reduce(lambda a, b: a | b, (equals(df, name, v) for v in values), F.lit(False))


def constraint(x: Column, op: str, value=None, low=None, high=None, low_inclusive: bool = True, high_inclusive: bool = False) -> Column:
    """One test: ``<  <=  >  >=  =  class`` with a value (``class``: a list), or ``range`` with its ends."""
    if op == "range":
        return (x >= low if low_inclusive else x > low) & (x <= high if high_inclusive else x < high)
    if op == "class":
        return x.isin(list(value))
    tests = {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value, "=": x == value}
    if op not in tests:
        raise ValueError(f"unknown operator {op!r}")
    return tests[op]


def property_filter(entries: Sequence[dict]) -> Column:
    """AND of entries ``{property, all: bool, constraints: [...]}``, each the AND or OR of its constraints."""
    out = F.lit(True)
    for e in entries:
        tests = [constraint(F.col(e["property"]), **c) for c in e["constraints"]]
        joined = reduce((lambda a, b: a & b) if e.get("all", True) else (lambda a, b: a | b), tests, F.lit(e.get("all", True)))
        out = out & joined
    return out


def pixel_mask(entries: Sequence[dict]) -> Column:
    """Like ``property_filter`` on bands, of which bits may be extracted first.

    An exclusive first bit widens the field by one downwards and an exclusive last bit by one upwards, as in existing
    recipes; unknown operators pass.
    """
    out = F.lit(True)
    for e in entries:
        tests = []
        for c in e["constraints"]:
            c = dict(c)
            x, first, last = F.col(e["band"]), c.pop("from_bit", None), c.pop("to_bit", None)
            first_in, last_in = c.pop("from_inclusive", True), c.pop("to_inclusive", True)
            if first is not None:
                x = bits.field(x, first - (not first_in), None if last is None else last + (not last_in))
            try:
                tests.append(constraint(x, **c))
            except ValueError:
                tests.append(F.lit(True))
        all_ = e.get("all", True)
        out = out & reduce((lambda a, b: a & b) if all_ else (lambda a, b: a | b), tests, F.lit(all_))
    return out


def masked(df: DataFrame, bands: Sequence[str], mask: Column) -> DataFrame:
    """``df`` with the bands masked (NULL) where ``mask`` does not hold."""
    return df.withColumns({b: F.when(mask, F.col(b)) for b in bands})


def remap(rules: Sequence[dict]) -> Column:
    """The value of the first rule that holds, else masked. A masked operand fails a rule; no constraint never holds."""
    out = None
    for r in rules:
        tests = [F.coalesce(constraint(F.col(c["band"]), **{k: v for k, v in c.items() if k != "band"}), F.lit(False)) for c in r["constraints"]]
        if not tests:
            continue
        test = reduce((lambda a, b: a & b) if r.get("all", True) else (lambda a, b: a | b), tests)
        out = F.when(test, r["value"]) if out is None else out.when(test, r["value"])
    return F.lit(None).cast("int") if out is None else out
