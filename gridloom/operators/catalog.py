"""Scene catalog, sessions, budgets and event history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from .selection import cover_scenes as cover_scenes


def scene_weight(cloud: Column, day_of_year: Column, target_day: int, season_weight: float) -> Column:
    """Sort weight of a scene: cloud cover in percent against distance from the target day, around the year's end."""
    return (1 - season_weight) * cloud / 100 + season_weight * dates.circular_days(day_of_year, target_day) / 182


def best_scenes(scenes: DataFrame, area: str, order: Sequence[str], cloud: str, least: int, most: int, target: float) -> DataFrame:
    """In order within each area, scenes until the product of cloud shares reaches the target: ``least`` at least,
    ``most`` at most; the scene that reaches it is taken.

    Only the first ``most`` scenes of an area are ranked on, which the top-k pushdown of windows cuts before the shuffle.
    """
    w = Window.partitionBy(area).orderBy(*order)
    first = scenes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    clear = F.max((F.col(cloud) <= 0).cast("int")).over(before)
    logs = F.sum(F.ln(F.greatest(F.col(cloud), F.lit(1e-12)) / 100)).over(before)
    product = F.when(clear == 1, F.lit(0.0)).otherwise(F.exp(logs))
    rows = first.withColumn("_before", F.coalesce(product, F.lit(1.0)))
    return rows.where((F.col("rank") <= least) | (F.col("_before") > target)).drop("_before")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order given: one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def changes_only(df: DataFrame, key: str, order: Sequence[str], state: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose state differs from the row before; rows in an excluded state are no states at all."""
    rows = df.where(~F.col(state).isin(list(exclude))) if exclude else df
    was = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_was", was).where(F.col("_was").isNull() | (F.col("_was") != F.col(state))).drop("_was")


def clipped_hours(start: Column, end: Column, month_start: str, month_end: str) -> Column:
    """Begun hours of [start, end) within a month; 0 if they do not meet."""
    lo, hi = F.greatest(start, F.lit(month_start).cast("timestamp_ntz")), F.least(end, F.lit(month_end).cast("timestamp_ntz"))
    seconds = F.timestamp_diff("SECOND", lo, hi)
    return F.when(seconds > 0, F.ceil(seconds / 3600)).otherwise(0)


def instance_spending(uses: DataFrame, prices: DataFrame, month_start: str, month_end: str) -> DataFrame:
    """Cost of each user's sessions in a month: begun hours at the instance's price, 0 for unknown types."""
    hours = clipped_hours(F.col("start"), F.col("end"), month_start, month_end)
    priced = uses.join(F.broadcast(prices), "type", "left")
    return priced.groupBy("user").agg(F.sum(hours * F.coalesce("price", F.lit(0.0))).alias("spending"))


def storage_hours(use: DataFrame, user: str, ts: str, gb: str) -> DataFrame:
    """Gigabyte hours by user and month: trapezoids between updates, from the month's start on for its first one."""
    month = F.date_trunc("month", F.col(ts).cast("timestamp")).cast("timestamp_ntz")
    w = Window.partitionBy(user).orderBy(ts)
    was, at = F.coalesce(F.lag(gb).over(w), F.lit(0.0)), F.greatest(F.coalesce(F.lag(ts).over(w), month), month)
    rows = use.select(user, month.alias("month"), ((was + F.col(gb)) / 2 * F.timestamp_diff("SECOND", at, F.col(ts)) / 3600).alias("gb_hours"))
    return rows.groupBy(user, "month").agg(F.sum("gb_hours").alias("gb_hours"))


def storage_spending(gb_hours: Column, price_month: float, month: Column) -> Column:
    return gb_hours * price_month / F.dayofmonth(F.last_day(month)) / 24


def with_defaults(df: DataFrame, overrides: DataFrame, key: str, defaults: dict[str, float]) -> DataFrame:
    """Values of a table of overrides, or the default row's."""
    found = df.join(overrides, key, "left")
    return found.select(*df.columns, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with rows updated or inserted."""
    return target.join(changes, list(keys), "left_anti").unionByName(changes)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``target`` with the rows of new keys: the first of each key in the order given."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    return target.unionByName(first.select(*target.columns).join(target.select(*keys), list(keys), "left_anti"))
