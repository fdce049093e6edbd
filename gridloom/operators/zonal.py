"""Statistics by zone, histograms, distinct values and table access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area_per_stratum(df: DataFrame, stratum: str, area: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.round(F.sum(area), 2).alias("area"), F.count("*").alias("n"))


def weighted_proportion(df: DataFrame, stratum: str, value: Column, area: str) -> DataFrame:
    """Area-weighted mean of ``value`` by stratum; 0 where there is no area."""
    total = F.sum(area)
    return df.groupBy(stratum).agg(F.coalesce(F.when(total > 0, F.sum(value * F.col(area)) / F.nullif(total, F.lit(0.0))), F.lit(0.0)).alias("proportion"))


def fixed_histogram(df: DataFrame, band: str, low: float, high: float, buckets: int) -> DataFrame:
    at = F.floor((F.col(band) - low) / ((high - low) / buckets))
    inside = df.where((F.col(band) >= low) & (F.col(band) < high))
    return inside.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str, most: int) -> DataFrame:
    """Sorted distinct values; an error if there are more than a legend can hold."""
    found = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    rows = found.limit(most + 1).collect()  # one run: at most a legend's values
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} distinct values")
    return df.sparkSession.createDataFrame(sorted(rows), found.schema)


def table_query(df: DataFrame, where: Column | None = None, distinct: Sequence[str] = (), sort: Sequence[str] = (), select: Sequence[str] = ()) -> DataFrame:
    """Filter, distinct by columns (the least row of each, by its other columns), sorts applied in sequence (the last key
    dominates), projection."""
    out = df if where is None else df.where(where)
    if distinct:
        rest = [c for c in out.columns if c not in distinct]
        out = out.groupBy(*distinct).agg(F.min(F.struct(*rest)).alias("_row")).select(*distinct, "_row.*") if rest else out.distinct()
    out = out.orderBy(*reversed(sort)) if sort else out
    return out.select(*select) if select else out


def page(df: DataFrame, key: str, offset: int, rows: int) -> DataFrame:
    """Rows ``offset`` to ``offset + rows`` in key order; only that many leave each task."""
    return df.orderBy(key).offset(offset).limit(rows)


def cdf(histogram: DataFrame, bucket: str, count: str) -> DataFrame:
    """Cumulative share by bucket; the histogram has a bounded number of buckets."""
    up = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("cdf", F.sum(count).over(up) / F.sum(count).over(Window.partitionBy()))


def normalize(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Bands to [0, 1] by their overall extremes; a constant band is divided by its value."""
    ends = df.agg(*(f(b).alias(f"_{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))))
    wide = df.join(F.broadcast(ends))
    new = {}
    for b in bands:
        lo, hi = F.col(f"_lo_{b}"), F.col(f"_hi_{b}")
        new[b] = F.when(hi > lo, (F.col(b) - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(F.col(b) / F.nullif(hi, F.lit(0.0)))
    return wide.withColumns(new).select(*df.columns)


def stretch(histogram: DataFrame, bucket: str, count: str, percent: float) -> DataFrame:
    """The last buckets from each side whose tails hold less than a share of all: ends of a display stretch (one row)."""
    up = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(count).over(Window.partitionBy())
    rows = histogram.withColumns({"_low": F.sum(count).over(up) / total, "_high": F.sum(count).over(down) / total})
    share = percent / 100
    low, high = F.max(F.when(F.col("_low") < share, F.col(bucket))), F.min(F.when(F.col("_high") < share, F.col(bucket)))
    return rows.agg(F.coalesce(low, F.min(bucket)).alias("low"), F.coalesce(high, F.max(bucket)).alias("high"))
