"""Composites: a collection of observations reduced to one row for each pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REDUCERS = {
    "MEDIAN": F.median,
    "MEAN": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "SD": F.stddev_pop,
    "COUNT": F.count,
    "SUM": F.sum,
}


def composite(df: DataFrame, keys: Sequence[str], bands: Sequence[str], kind: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(REDUCERS[kind](b).alias(b) for b in bands))


def mosaic(df: DataFrame, keys: Sequence[str], bands: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last unmasked value of each band, in the order given."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.max_by(b, F.when(F.col(b).isNotNull(), at)).alias(b) for b in bands))


def mode(df: DataFrame, keys: Sequence[str], band: str) -> DataFrame:
    """Most frequent value, the smallest of equally frequent ones; counted before it is ranked."""
    counts = df.where(F.col(band).isNotNull()).groupBy(*keys, band).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(band, F.struct("_n", -F.col(band))).alias(band))


def quality_mosaic(df: DataFrame, keys: Sequence[str], quality: str, order: Sequence[str]) -> DataFrame:
    """The whole row of the largest quality; ties go to the last in the order given."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(quality, *order)).alias("_row")
    return df.where(F.col(quality).isNotNull()).groupBy(*keys).agg(best).select(*keys, "_row.*")


def medoid(df: DataFrame, keys: Sequence[str], bands: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The observation nearest to the pixel's medians, over the bands."""
    medians = df.groupBy(*keys).agg(*(F.median(b).alias(f"_m_{b}") for b in bands))
    far = sum(F.pow(F.col(b) - F.col(f"_m_{b}"), F.lit(2.0)) for b in bands)
    near = df.join(medians, list(keys)).withColumn("_quality", F.round(-F.sqrt(far), 9)).drop(*(f"_m_{b}" for b in bands))
    return quality_mosaic(near, keys, "_quality", order).drop("_quality")


def percentile_mask(df: DataFrame, keys: Sequence[str], band: str, percent: float) -> DataFrame:
    """Rows whose band reaches the pixel's percentile; 0 keeps all."""
    if percent == 0:
        return df
    limits = df.groupBy(*keys).agg(F.percentile(band, percent / 100).alias("_limit"))
    return df.join(limits, list(keys)).where(F.col(band) >= F.col("_limit")).drop("_limit")


def outlier_mask(df: DataFrame, keys: Sequence[str], bands: Sequence[str], k: float) -> DataFrame:
    """Rows within the median plus or minus k standard deviations of their pixel in every band."""
    stats = df.groupBy(*keys).agg(*(f(b).alias(f"_{n}_{b}") for b in bands for n, f in (("m", F.median), ("s", F.stddev_pop))))
    near = df.join(stats, list(keys))
    for b in bands:
        near = near.where(F.abs(F.col(b) - F.col(f"_m_{b}")) <= k * F.col(f"_s_{b}"))
    return near.select(*df.columns)


def above_median_share(df: DataFrame, keys: Sequence[str], score: str, share: float) -> DataFrame:
    """Rows whose score exceeds a share of the pixel's median score (shadows fall below)."""
    medians = df.groupBy(*keys).agg(F.median(score).alias("_median"))
    return df.join(medians, list(keys)).where(F.col(score) > share * F.col("_median")).drop("_median")


def enough_observations(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of pixels with at least ``least`` observations."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(counts, list(keys), "left_semi")


def preferred(df: DataFrame, keys: Sequence[str], choice: str) -> DataFrame:
    """Rows with the pixel's most frequent value of a column (one orbit where several overlap)."""
    best = mode(df, keys, choice).withColumnRenamed(choice, "_best")
    return df.join(best, list(keys)).where(F.col(choice) == F.col("_best")).drop("_best")


def without_holes(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Rows that are not flagged, but all rows of pixels where every row is flagged."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_all", F.min(F.col(flag).cast("int")).over(w)).where((F.col("_all") == 1) | ~F.col(flag)).drop("_all")
