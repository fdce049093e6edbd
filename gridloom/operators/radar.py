"""Radar backscatter: natural units, time scans, edges of the swath, and Bayesian speckle filters on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masks
from . import neighbourhood


def gamma0(sigma0: Column, angle: Column) -> Column:
    """Backscatter normalised by the incidence angle in degrees."""
    return sigma0 / F.cos(F.radians(angle))


def decibels(x: Column) -> Column:
    return 10 * F.log10(x)


def natural(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def inside_swath(angle: Column, least: float = 30.63993, most: float = 45.23993) -> Column:
    """Whether an incidence angle lies off the swath's edges, where noise prevails."""
    return (angle > least) & (angle < most)


def time_scan(df: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Of each band in decibels: least, largest, mean, deviation, median and variation ``cv`` (deviation over the mean in
    natural units, in decibels); of the first two bands also their ratio (difference of medians) and normalised ``cv``."""
    parts = []
    for b in bands:
        cv = decibels(F.stddev_pop(b) / F.avg(natural(F.col(b))))
        parts += [F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max"), F.avg(b).alias(f"{b}_mean"), F.stddev_pop(b).alias(f"{b}_std"), F.median(b).alias(f"{b}_med"), cv.alias(f"{b}_cv")]
    out = df.groupBy(*keys).agg(*parts)
    if len(bands) > 1:
        a, b = bands[:2]
        out = out.withColumns({"ratio": F.col(f"{a}_med") - F.col(f"{b}_med"), "ndcv": masks.ratio(F.col(f"{a}_cv") - F.col(f"{b}_cv"), F.col(f"{a}_cv") + F.col(f"{b}_cv"))})
    return out


def orbit_history(df: DataFrame, key: str, orbit: str, bands: Sequence[str]) -> DataFrame:
    """Mean and deviation of each band in ascending and descending passes, as ``<band>_mean_asc`` and so on."""
    parts = []
    for suffix, name in (("asc", "ASCENDING"), ("desc", "DESCENDING")):
        for b in bands:
            v = F.when(F.col(orbit) == name, F.col(b))
            parts += [F.avg(v).alias(f"{b}_mean_{suffix}"), F.stddev_pop(v).alias(f"{b}_std_{suffix}")]
    return df.groupBy(key).agg(*parts)


def gamma_map(df: DataFrame, value: str, radius: int, looks: float = 4.0) -> DataFrame:
    """Maximum a posteriori speckle filter under a gamma prior: the mean where the window is uniform, the pixel where it
    varies strongly, and between the positive root of the posterior's equation."""
    stats = neighbourhood.focal(df, value, radius)
    m, x = F.col("mean"), F.col(value)
    cu2 = 1 / looks
    ci = F.sqrt("variance") / F.nullif(m, F.lit(0.0))
    alpha = (1 + cu2) / F.nullif(ci * ci - cu2, F.lit(0.0))
    b = alpha - looks - 1
    root = (b * m + F.sqrt(F.greatest(m * m * b * b + 4 * alpha * looks * m * x, F.lit(0.0)))) / (2 * alpha)
    return stats.withColumn("filtered", F.when(ci.isNull() | (ci <= cu2**0.5), m).when(ci < (2 * cu2) ** 0.5, root).otherwise(x))


def distance_to(df: DataFrame, flag: Column, radius: int) -> DataFrame:
    """Pixels with ``distance`` (Euclidean, in pixels) to the nearest flagged one within a square of ``radius``; masked beyond.

    Flagged pixels are sent to the cells around them and reduced by a map-side minimum.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    sent = df.where(flag).select("x", "y").withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    near = sent.groupBy((F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y")).agg(F.min(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).alias("_d2"))
    return df.join(near, ["x", "y"], "left").withColumn("distance", F.sqrt("_d2")).drop("_d2")
