"""Users, their spending and their silence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with each row's ``place`` from 1 in a total order, without one task that sorts all.

    Rows are parted by range; each part's size shifts the numbers of the parts after it. Only a row a part is summed
    in one place. The bounds of the parts come from a sample that another run would draw anew, so the parted rows are written
    once, and both their sizes and their places are read from there.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = staged(df.repartitionByRange(n, *columns).withColumn("_part", F.spark_partition_id()), "parts")
    inside = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*columns)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = inside.join(F.broadcast(starts), "_part")
    return out.withColumn("place", F.col("_before") + F.col("_local")).select(*df.columns, "place")


def by_name(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows of the given names, whatever their case."""
    return df.where(F.lower(column).isin([n.lower() for n in names]))


def last_login(logins: DataFrame, user: str, at: str, failed: str) -> DataFrame:
    """``(username, last_login)``: latest time of each user's logins that did not fail; names are lower-cased."""
    good = logins.where((~F.col(failed)) & F.col(at).isNotNull())
    return good.groupBy(F.lower(user).alias("username")).agg(F.max(at).alias("last_login"))


def present(df: DataFrame, removed: str, state: str, not_in: Sequence[str]) -> DataFrame:
    """Rows that are not removed and in none of the states."""
    return df.where(~F.col(removed) & ~F.col(state).isin(list(not_in)))


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows of which each word of ``text`` occurs in some column, whatever its case; no word finds all."""
    for word in text.split():
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(c), F.lit(word.lower()))
        df = df.where(hit)
    return df


def spending_report(budgets: DataFrame, instance: DataFrame, storage: DataFrame, user: str) -> DataFrame:
    """Every user's budgets with what they spent; nothing spent is 0."""
    out = budgets.join(instance, user, "left").join(storage, user, "left")
    return out.fillna(0.0, ["instance", "storage"])


def over_budget(report: DataFrame, user: str) -> DataFrame:
    """Users who reach their instance budget, their storage budget or their quota, and which of them."""
    tests = {"over_instance": F.col("instance") >= F.col("instance_budget"), "over_storage": F.col("storage") >= F.col("storage_budget"), "over_quota": F.col("storage") >= F.col("quota")}
    rows = report.select(user, *(t.alias(n) for n, t in tests.items()))
    return rows.where("over_instance or over_storage or over_quota")


def silent(lines: DataFrame, tag: str, at: str, order: Sequence[str], timeout: int) -> DataFrame:
    """``(tag, fires_at)``: when no line of a tag has come for ``timeout`` seconds, armed again by its next line."""
    w = Window.partitionBy(tag).orderBy(at, *order)
    rows = lines.withColumn("_next", F.lead(at).over(w))
    until = F.col(at) + F.expr(f"interval {timeout} seconds")
    return rows.where(F.col("_next").isNull() | (F.col("_next") > until)).select(tag, until.alias("fires_at"))


def rescan_delay(scans: DataFrame, key: str, order: Sequence[str], size: str, active: str, factor: float, least: float, most: float) -> DataFrame:
    """``scans`` with the ``delay`` to the next scan of the same key (without its random part).

    A scan while the key is ``active`` is followed by the least delay. Otherwise a changed size (the first one is a change) gives
    the least delay and an unchanged one the delay last used times ``factor``, until the most is reached: there it stays,
    whatever the size does, until the key is active again. Runs are counted by sorted windows, so no key is gathered.
    """
    whole = Window.partitionBy(key).orderBy(*order)
    so_far = whole.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag(size).over(whole)
    changed = F.col(active) | before.isNull() | (F.col(size) != before)
    rows = scans.withColumns({"_changed": changed, "_stay": F.sum(F.col(active).cast("int")).over(so_far)})
    rows = rows.withColumn("_run", F.sum(F.col("_changed").cast("int")).over(so_far))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)) - 1)
    grown = F.least(F.lit(least) * F.pow(F.lit(factor), F.col("_k")), F.lit(most))
    reached = F.max((grown >= most).cast("int")).over(Window.partitionBy(key, "_stay").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("delay", F.when(reached == 1, F.lit(most)).otherwise(grown)).drop("_changed", "_stay", "_run", "_k")


def inactivity_state(df: DataFrame, last: str, now: str, note: int, notify: int, erase: int) -> DataFrame:
    """The state that a user's silence has led to, after so many hours each."""
    hours = (F.unix_micros(F.col(now).cast("timestamp")) - F.unix_micros(F.col(last).cast("timestamp"))) / 3.6e9
    return df.withColumn("state", F.when(hours > erase, "ERASE").when(hours > notify, "NOTIFY").when(hours > note, "NOTE").otherwise("ACTIVE"))
