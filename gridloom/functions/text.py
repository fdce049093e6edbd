"""Text keys for matching and sorting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple(x: Column) -> Column:
    """Upper case, letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9 ]", ""), " +", " "))


def matches_all(tokens: list[str], *columns: Column) -> Column:
    """Every token occurs in one of the columns, whatever the case."""
    out = F.lit(True)
    for token in tokens:
        one = F.lit(False)
        for c in columns:
            one = one | F.contains(F.lower(c), F.lit(token.lower()))
        out = out & one
    return out


def natural(x: Column, width: int = 12) -> Column:
    """Sort key in which the first number in a name counts as a number."""
    digits = F.regexp_extract(x, "([0-9]+)", 1)
    return F.concat(F.regexp_replace(x, "[0-9].*$", ""), F.lpad(digits, width, "0"), F.regexp_replace(x, "^[^0-9]*[0-9]*", ""))
