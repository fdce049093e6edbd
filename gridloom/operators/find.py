"""Picks among a pixel's segments, with bands made and masks set on the way; samples and classes of segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import learning
from . import segments as S


class Find:
    """A chain over the segments of every pixel, planned as one aggregation: ``Find(segments, key).add_bands(...).update_mask(...).max("x")``.

    Segments are in order of ``t_start``. Picks give a row for each pixel, masked bands being null; pixels without segments have none.
    """

    def __init__(self, segments: DataFrame, key: str):
        self.rows, self.key = segments.withColumn("_at", F.col("t_start")), key
        self.bands = [c for c in segments.columns if c != key]

    def _with(self, rows: DataFrame, bands: Sequence[str]) -> Find:
        out = object.__new__(Find)
        out.rows, out.key, out.bands = rows, self.key, list(bands)
        return out

    def add_bands(self, **bands: Column) -> Find:
        """New bands, or bands that replace those of their name."""
        return self._with(self.rows.withColumns(bands), [*self.bands, *(b for b in bands if b not in self.bands)])

    def update_mask(self, keep: Column) -> Find:
        """All bands of a segment are masked where ``keep`` does not hold."""
        kept = F.coalesce(keep, F.lit(False))
        return self._with(self.rows.withColumn("_keep", kept).withColumns({b: F.when(F.col("_keep"), F.col(b)) for b in self.bands}).drop("_keep"), self.bands)

    def _ends(self, pick) -> DataFrame:
        return self.rows.groupBy(self.key).agg(*(pick(F.col(b), F.when(F.col(b).isNotNull(), F.col("_at"))).alias(b) for b in self.bands))

    def first(self) -> DataFrame:
        """Each band's first value that is not masked."""
        return self._ends(F.min_by)

    def last(self) -> DataFrame:
        return self._ends(F.max_by)

    def _extreme(self, band: str, best) -> DataFrame:
        rows = self.rows.withColumn("_best", best(band).over(Window.partitionBy(self.key)))
        found = F.col(band) == F.col("_best")
        return rows.groupBy(self.key).agg(*(F.max_by(F.col(b), F.when(found & F.col(b).isNotNull(), F.col("_at"))).alias(b) for b in self.bands))

    def min(self, band: str) -> DataFrame:
        """The segment of the least value of a band, the last of equal ones; all bands are null where the band is masked everywhere."""
        return self._extreme(band, F.min)

    def max(self, band: str) -> DataFrame:
        return self._extreme(band, F.max)


def sampled(points: DataFrame, segments: DataFrame, key: str, t: str, bands: Mapping[str, Column]) -> DataFrame:
    """``points`` (without their date ``t``) with ``bands`` of the segment that covers it at their pixel; points that none covers go.

    ``bands`` are columns over a segment's own.
    """
    own = [c for c in segments.columns if c != key]
    at = points.select(key, F.col(t).cast("double").alias("t")).distinct()
    found = S.lookup(segments, at, key, "mask", own).where("t_start is not null")
    made = found.select(F.col(key).alias("_k"), F.col("t").alias("_t"), *(c.alias(n) for n, c in bands.items()))
    rows = points.join(made, (F.col(key) == F.col("_k")) & (F.col(t).cast("double") == F.col("_t")))
    return rows.select(*(c for c in points.columns if c != t), *bands)


def classified(train: DataFrame, segments: DataFrame, features: Mapping[str, Column], label: str, kind: str, **options) -> DataFrame:
    """``segments`` with ``type``, the class that a model trained on ``train`` (of ``sampled``: features and label) gives each of them.

    Segments with a masked feature have a masked type.
    """
    made = segments.select("*", *(c.alias(n) for n, c in features.items()))
    out = learning.classify(train, made, list(features), label, kind, **options)
    return out.select(*segments.columns, F.col("class").alias("type"))
