"""Moving windows over gridded pixels: rows (x, y, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def focal(df: DataFrame, value: str, radius: int) -> DataFrame:
    """Count, mean and variance of the square window around each pixel.

    Each pixel is sent to its window's cells and summed there: an aggregation with map-side sums, not a self-join.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    v = F.col(value)
    sent = df.where(v.isNotNull()).select("x", "y", v.alias("_v")).withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    sums = sent.groupBy((F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y")).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("variance"))
    return df.join(sums, ["x", "y"])


def lee(df: DataFrame, value: str, radius: int, looks: float = 4.0) -> DataFrame:
    """Minimum mean-square-error speckle filter: between the window's mean and the pixel, by the local variance."""
    s2 = 1 / looks
    stats = focal(df, value, radius)
    m, z = F.greatest("mean", F.lit(0.0)), F.col("variance")
    x = (z - m * m * s2) / (1 + s2)
    b = F.greatest(x / F.nullif(z, F.lit(0.0)), F.lit(0.0))
    return stats.withColumn("filtered", F.coalesce((1 - b) * m + b * F.col(value), m))


def buffered(df: DataFrame, flag: Column, radius: int) -> DataFrame:
    """Pixels within ``radius`` (square) of a flagged one get ``near`` true."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    sent = df.where(flag).select("x", "y").withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    near = sent.select((F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y")).distinct().withColumn("near", F.lit(True))
    return df.join(near, ["x", "y"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
