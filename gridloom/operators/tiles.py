"""Neighbourhoods of any size over gridded pixels, tile by tile: rows (x, y, values), y growing downwards.

A pixel goes to its own tile and to those that have it in their margin; with tiles much larger than the margin nearly every
pixel is sent once, whatever the size of the window. A tile is one group of at most (side + 2 margin)^2 pixels.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

SIDE = 256
#: Pixels of a strip of rows that distances are found in at once.
CELLS = 1 << 18


def by_tile(df: DataFrame, values: Sequence[str], margin: int, compute: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: Sequence[str], side: int = SIDE) -> DataFrame:
    """``df`` (x, y, values) with the doubles ``out`` that ``compute`` makes of each tile's arrays (rows y, columns x, NaN where
    masked or missing). Masked results are null. Pixels that repeat a place take one of its values."""
    lo, hi = (lambda c: F.floor((F.col(c) - margin) / side), lambda c: F.floor((F.col(c) + margin) / side))
    sent = df.select("x", "y", *(F.col(v).cast("double").alias(v) for v in values))
    for axis in "xy":
        sent = sent.withColumn(f"_t{axis}", F.explode(F.sequence(lo(axis), hi(axis))))
    width = side + 2 * margin

    def run(key: tuple, tile: pa.Table) -> pa.Table:
        x0, y0 = (k.as_py() * side - margin for k in key)
        xs, ys = tile["x"].to_numpy(), tile["y"].to_numpy()
        arrays = {}
        for v in values:
            arrays[v] = np.full((width, width), np.nan)
            arrays[v][ys - y0, xs - x0] = tile[v].to_numpy()
        with np.errstate(all="ignore"):
            made = compute(arrays)
        own = (xs - x0 >= margin) & (xs - x0 < margin + side) & (ys - y0 >= margin) & (ys - y0 < margin + side)
        columns = [pa.array(xs[own]), pa.array(ys[own]), *(pa.array(made[n][ys[own] - y0, xs[own] - x0], from_pandas=True) for n in out)]
        return pa.table(columns, names=["x", "y", *out])

    found = sent.groupBy("_tx", "_ty").applyInArrow(run, f"x {dict(df.dtypes)['x']}, y {dict(df.dtypes)['y']}, {', '.join(f'{n} double' for n in out)}")
    return df.join(found.dropDuplicates(["x", "y"]), ["x", "y"])


def shifted(a: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The array whose element (y, x) is that of (y + dy, x + dx); NaN beyond the edge."""
    out = np.full_like(a, np.nan)
    h, w = a.shape
    out[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = a[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


def moments(a: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the pixels that are not masked under a kernel of zeros and ones, centred on each pixel."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    n, total, rest = np.zeros_like(a), np.zeros_like(a), np.zeros_like(a)
    places = [(dx - rx, dy - ry) for dy, dx in zip(*np.nonzero(kernel), strict=True)]
    for dx, dy in places:
        s = shifted(a, dx, dy)
        there = ~np.isnan(s)
        n += there
        total += np.where(there, s, 0)
    mean = total / np.where(n > 0, n, np.nan)
    for dx, dy in places:
        s = shifted(a, dx, dy)
        rest += np.where(np.isnan(s), 0, (s - mean) ** 2)
    return mean, rest / np.where(n > 0, n, np.nan)


def least_squares(image: np.ndarray, window: np.ndarray, kernel: np.ndarray, deviation: float) -> np.ndarray:
    """Between the mean of the window and the pixel, by how much of the window's variance is not noise."""
    mean, variance = moments(window, kernel)
    mean = np.maximum(mean, 0)
    share = np.maximum((variance - mean**2 * deviation**2) / (1 + deviation**2) / variance, 0)
    return np.where(np.isnan(share), mean, (1 - share) * mean + share * image)


# Bounds of the sigma range and its deviation, by the share of pixels that it is to hold.
SIGMA = {
    0.50: (0.694, 1.385, 0.1921), 0.60: (0.630, 1.495, 0.2348), 0.70: (0.560, 1.627, 0.2825), 0.80: (0.480, 1.804, 0.3354), 0.90: (0.378, 2.094, 0.3991), 0.95: (0.302, 2.360, 0.4391),
}


def lee_sigma(df: DataFrame, value: str, radius: int, sigma: float = 0.9, noise: float = 0.5, strong: float | None = None, side: int = SIDE) -> DataFrame:
    """Improved sigma filter: only pixels in the sigma range around a first estimate (of the 3 by 3 window) are averaged.

    A window without one in range is masked; pixels above ``strong`` are kept as they are.
    """
    low, high, deviation = SIGMA[sigma]

    def compute(tile: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        image = tile[value]
        guess = least_squares(image, image, np.ones((3, 3)), noise)
        kept = np.where((image >= low * guess) & (image < high * guess), image, np.nan)
        out = least_squares(image, kept, np.ones((2 * radius + 1, 2 * radius + 1)), deviation)
        return {"filtered": out if strong is None else np.where(image > strong, image, out)}

    return by_tile(df, [value], radius + 1, compute, ["filtered"], side)


def refined_lee(df: DataFrame, value: str, strong: float | None = None, side: int = SIDE) -> DataFrame:
    """Speckle filter by the half window, of eight directions, that the strongest gradient of nine sampled 3 by 3 windows leaves
    on the pixel's side; the noise is the mean of the five least relative variances of these.

    Masked where one of the sampled windows is empty, or where two gradients are equal.
    """
    rectangle = np.vstack([np.zeros((3, 7)), np.ones((4, 7))])
    diagonal = np.tril(np.ones((7, 7)))

    def compute(tile: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        image = tile[value]
        mean, variance = moments(image, np.ones((3, 3)))
        at = [(dx, dy) for dy in (-2, 0, 2) for dx in (-2, 0, 2)]
        m = [shifted(mean, *p) for p in at]
        relative = np.sort(np.stack([shifted(variance, *p) for p in at]) / np.stack(m) ** 2, axis=0)[:5].mean(axis=0)
        pairs = ((1, 7), (6, 2), (3, 5), (0, 8))
        gradients = np.stack([np.abs(m[a] - m[b]) for a, b in pairs])
        steepest = gradients == gradients.max(axis=0)
        toward = np.stack([m[a] - m[4] > m[4] - m[b] for a, b in pairs])
        direction = np.where(steepest.sum(axis=0) == 1, (steepest * np.where(toward, np.arange(1, 5)[:, None, None], np.arange(5, 9)[:, None, None])).sum(axis=0), 0)
        out = np.full_like(image, np.nan)
        for turn in range(4):
            for odd, kernel in enumerate((rectangle, diagonal)):
                mean, variance = moments(image, np.rot90(kernel, -turn))
                share = (variance - mean**2 * relative) / (1 + relative) / variance
                found = np.where(np.isnan(share), mean, mean + share * (image - mean))
                out = np.where(direction == 2 * turn + odd + 1, found, out)
        out = np.where(np.isnan(np.stack(m)).any(axis=0), np.nan, out)
        return {"filtered": out if strong is None else np.where(image > strong, image, out)}

    return by_tile(df, [value], 4, compute, ["filtered"], side)


def _envelope(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each of ``x``, the least of (x - x')^2 + d(x') over all, by the lower envelope of the parabolas: linear in their number."""
    some = np.isfinite(d)
    xs, heights = x[some], (d + x**2)[some].tolist()
    spots, starts = [], []
    for i, (place, height) in enumerate(zip(xs.tolist(), heights, strict=True)):
        while spots:
            j, from_, before = spots[-1]
            cross = (height - before) / (2.0 * (place - from_))
            if cross > starts[-1]:
                break
            spots.pop()
            starts.pop()
        starts.append(cross if spots else -np.inf)
        spots.append((i, place, height))
    if not spots:
        return np.full(len(x), np.nan)
    best = np.array([s[0] for s in spots])[np.searchsorted(np.array(starts), x, side="right") - 1]
    return (x - xs[best]) ** 2 + d[some][best]


def distance_transform(df: DataFrame, flag: Column) -> DataFrame:
    """Pixels with ``distance``, Euclidean and in pixels, to the nearest flagged one at any distance; masked if none is flagged.

    Two passes: along columns by sorted windows, then along rows by the envelope of what these found. Every pixel is shuffled twice,
    whatever the distances; a group is a strip of whole rows of the grid, of about CELLS pixels (one row, where it is wider). Rows are
    filled out to the extent of the flagged pixels, so that places without a pixel are crossed.
    """
    rows = df.select("x", "y", F.coalesce(flag, F.lit(False)).alias("_f")).groupBy("x", "y").agg(F.max("_f").alias("_f"))
    rows = staged(rows, "distance-flags")  # several steps read them
    ends = rows.where("_f").agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    if ends["a"] is None:
        return df.withColumn("distance", F.lit(None).cast("double"))
    width = rows.agg(F.max("x") - F.min("x") + 1).first()[0]
    filled = rows.select("y").distinct().select(F.explode(F.sequence(*(F.lit(e).cast(dict(rows.dtypes)["x"]) for e in ends))).alias("x"), "y", F.lit(False).alias("_f"))
    grid = rows.unionByName(filled.select("x", "y", "_f")).groupBy("x", "y").agg(F.max("_f").alias("_f"))
    at = F.when(F.col("_f"), F.col("y"))
    # both ways from the start: a frame that runs to the end is computed anew for each of its rows
    up, down = (F.last(at, True).over(Window.partitionBy("x").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("y"), F.desc("y")))
    near = grid.select("x", "y", F.least(F.col("y") - up, down - F.col("y")).cast("double").alias("_d"))

    def run(strip: pa.Table) -> pa.Table:
        strip = strip.sort_by([("y", "ascending"), ("x", "ascending")])
        x, y, d = (strip[c].to_numpy() for c in ("x", "y", "_d"))
        d = np.where(np.isnan(d), np.inf, d**2)
        cuts = [0, *(np.flatnonzero(np.diff(y)) + 1), len(y)]
        found = np.concatenate([_envelope(x[a:b].astype(float), d[a:b]) for a, b in itertools.pairwise(cuts)])
        return pa.table([strip["x"], strip["y"], pa.array(np.sqrt(found), from_pandas=True)], names=["x", "y", "distance"])

    kinds = dict(near.dtypes)
    strips = near.groupBy(F.floor(F.col("y") / max(1, CELLS // int(width))).alias("_strip"))
    found = strips.applyInArrow(run, f"x {kinds['x']}, y {kinds['y']}, distance double")
    return df.join(found, ["x", "y"])


def slope_aspect(df: DataFrame, height: str, size: float) -> DataFrame:
    """``slope`` and ``aspect`` (azimuth of the descent, clockwise from north), radians, from the four neighbours of each pixel by
    central differences; ``size`` is a pixel's side in the unit of height. Masked at edges and beside missing pixels."""
    def neighbours(along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        back = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(height).over(w))
        ahead = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(height).over(w))
        return (ahead - back) / (2 * size)

    rows = df.withColumn("_e", neighbours("x", "y")).withColumn("_n", -neighbours("y", "x"))
    aspect = F.atan2(-F.col("_e"), -F.col("_n"))
    turned = F.when(F.isnotnull("_e") & F.isnotnull("_n"), F.when(aspect < 0, aspect + 2 * np.pi).otherwise(aspect))
    return rows.withColumns({"slope": F.atan(F.hypot("_e", "_n")), "aspect": turned}).drop("_e", "_n")


def terrain_flattened(df: DataFrame, bands: Sequence[str], incidence: Column, look: Column, model: str = "volume", buffer: float = 0.0) -> DataFrame:
    """Backscatter ``bands`` (natural units) flattened by ``slope`` and ``aspect`` under an incidence and a look direction, in radians.

    ``model``: volume or surface scattering. Layover (the slope in range beyond the incidence) and shadow are masked, and so are pixels
    no further than ``buffer`` pixels from them.
    """
    facing = look - F.when(F.col("aspect") > np.pi, F.col("aspect") - 2 * np.pi).otherwise(F.col("aspect"))
    in_range, in_azimuth = F.atan(F.tan("slope") * F.cos(facing)), F.atan(F.tan("slope") * F.sin(facing))
    right = np.pi / 2 - incidence
    ratio = F.tan(right + in_range) / F.tan(right) if model == "volume" else F.cos(right) / (F.cos(in_azimuth) * F.cos(right + in_range))
    seen = (in_range < incidence) & (in_range > -right)
    rows = df.withColumns({"_ok": F.coalesce(seen, F.lit(False)), **{b: F.col(b) / F.cos(incidence) / ratio for b in bands}})
    if buffer > 0:
        rows = distance_transform(rows, ~F.col("_ok"))
        rows = rows.withColumn("_ok", F.col("_ok") & (F.col("distance").isNull() | (F.col("distance") > buffer))).drop("distance")
    return rows.select(*(F.when(F.col("_ok"), F.col(c)).alias(c) if c in bands else F.col(c) for c in df.columns))
