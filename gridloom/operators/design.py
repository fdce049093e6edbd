"""Sampling design, second half: sizes from margins, proportions, minimums, outcomes, checks, candidate lattices.

A design has a handful of strata; what works on them alone is plain Python, what works on cells is Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from . import sampling as S

#: Fewest samples of a stratum for its variance, and the largest sample size that is searched (fixed values).
FLOOR, LARGEST = 2, 10**12


def least_where(test: Callable[[int], bool], low: int = 1, high: int = LARGEST) -> int | None:
    """The least whole number in [low, high] for which a monotone test holds, by bisection; None if none does."""
    if not test(high):
        return None
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if test(mid) else (mid + 1, high)
    return low


def margin_at(n: int, weights: Sequence[float], proportions: Sequence[float], confidence: float, strategy: str = "PROPORTIONAL", least: int = 1) -> float:
    """The relative margin of error of a sample of ``n`` dealt to strata."""
    sizes = S.allocate(n, weights, strategy, proportions, min(least, n // len(weights)))
    low, p, high = S.confidence_bounds([(w, x, max(k, 1)) for w, x, k in zip(weights, proportions, sizes, strict=True)], confidence)
    return S.margin_of_error(low, p, high)


def sample_size(margin: float, weights: Sequence[float], proportions: Sequence[float], confidence: float, strategy: str = "PROPORTIONAL") -> int | None:
    """The least sample whose margin of error is at most ``margin``."""
    return least_where(lambda n: margin_at(n, weights, proportions, confidence, strategy) <= margin, len(weights))


def smart_round(x: float, digits: int = 3) -> float:
    """``x`` at so many significant digits."""
    return 0.0 if x == 0 else round(x, digits - 1 - math.floor(math.log10(abs(x))))


def proportions(probabilities: Sequence[float], weights: Sequence[float], overall: float | None = None) -> list[float]:
    """Proportions of strata from their mean probabilities in per cent, or scaled so that the weighted mean is ``overall``; at most 1."""
    shares = [p / 100 for p in probabilities]
    if overall is not None:
        mean = sum(w * p for w, p in zip(weights, shares, strict=True))
        shares = [p * overall / mean if mean else overall for p in shares]
    return [min(p, 1.0) for p in shares]


def least_samples(strategy: str, configured: int | None, manual: bool = False) -> int:
    """The minimum of each stratum: what is configured, no less than FLOOR; equal and manual allocations have the floor only."""
    return FLOOR if strategy == "EQUAL" or manual or configured is None else max(FLOOR, configured)


def least_samples_column(strategy: str, configured: str, manual: str) -> Column:
    """``least_samples`` of many designs, as columns."""
    floor_only = (F.col(strategy) == "EQUAL") | F.col(manual) | F.col(configured).isNull()
    return F.when(floor_only, F.lit(FLOOR)).otherwise(F.greatest(F.lit(FLOOR), F.col(configured)))


def outcome_status(n: str, strata: int, least: Column) -> Column:
    """Status of ``outcome`` for many designs whose size is known, or null where no size reaches the margin."""
    return F.when(F.col(n).isNull(), "MARGIN_UNREACHABLE").when(F.col(n) < least * strata, "SAMPLE_TOO_SMALL").otherwise("OK")


def outcomes(designs: DataFrame, weights: Sequence[float], shares: Sequence[float], n: str, strategy: str, least: Column) -> DataFrame:
    """``designs`` with ``status`` and ``sizes``, the allocation to strata in their order: empty unless the status is OK.

    Equal designs are allocated once: each distinct one is a row of its own, and Spark deals them.
    """
    rows = designs.withColumns({"_least": least.cast("int"), "status": outcome_status(n, len(weights), least)})
    w, p = list(weights), list(shares)

    def allocated(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = [S.allocate(int(m), w, s, p, int(at_least)) for m, s, at_least in part[["_m", "_s", "_l"]].itertuples(index=False)]
            yield part.assign(sizes=sizes)

    named = rows.where("status = 'OK'").select(F.col(n).cast("int").alias("_m"), F.col(strategy).alias("_s"), F.col("_least").alias("_l")).distinct()
    made = named.mapInPandas(allocated, "_m int, _s string, _l int, sizes array<int>")
    same = (rows["status"] == "OK") & (rows[n] == made["_m"]) & (rows[strategy] == made["_s"]) & (rows["_least"] == made["_l"])
    return rows.join(made, same, "left").select(*designs.columns, "status", F.coalesce("sizes", F.array().cast("array<int>")).alias("sizes"))


def outcome(n: int | None, margin: float | None, weights: Sequence[float], shares: Sequence[float], confidence: float, strategy: str, configured: int | None = None) -> dict:
    """Sizes of strata and their margin of error, from a sample size or from the margin wanted; or why there are none."""
    least = least_samples(strategy, configured)
    if n is None:
        n = sample_size(margin, weights, shares, confidence, strategy) if margin else None
        if n is None:
            return {"status": "MARGIN_UNREACHABLE", "sizes": [], "margin": math.inf}
        n = max(n, least * len(weights))
    if n < least * len(weights):
        return {"status": "SAMPLE_TOO_SMALL", "sizes": [], "margin": math.inf}
    sizes = S.allocate(n, weights, strategy, shares, least)
    low, p, high = S.confidence_bounds(list(zip(weights, shares, sizes, strict=True)), confidence)
    return {"status": "OK", "sizes": sizes, "margin": S.margin_of_error(low, p, high)}


def arrangement(kind: str, scale: float, least_distance: float | None = None, grid: Mapping | None = None) -> dict:
    """What an arrangement means: no grid stays no grid; without a distance it is twice the pixel."""
    out = {"kind": kind, "least_distance": 2 * scale if least_distance is None else least_distance}
    return out | ({"grid": dict(grid)} if grid is not None else {})


def allocation_differences(given: DataFrame, strata: DataFrame, stratum: str) -> DataFrame:
    """``(stratum, problem)``: strata without an allocation, allocations of no stratum, and those that are given twice."""
    counts = given.groupBy(stratum).agg(F.count("*").alias("_n"))
    both = strata.select(stratum, F.lit(True).alias("_known")).distinct().join(counts, stratum, "full")
    problem = F.when(F.col("_n").isNull(), "MISSING").when(F.col("_known").isNull(), "UNEXPECTED").when(F.col("_n") > 1, "DUPLICATE")
    return both.select(stratum, problem.alias("problem")).where("problem is not null")


def shortfalls(sizes: DataFrame, actual: DataFrame, stratum: str) -> DataFrame:
    """``(stratum, size, actual, short)`` of strata that have fewer samples than asked for; none counts as 0."""
    rows = sizes.join(actual, stratum, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return rows.withColumn("short", F.col("size") - F.col("actual")).where("short > 0").select(stratum, "size", "actual", "short")


def advice(verdicts: DataFrame, stratum: str, over: Sequence[str] = ("BELOW_STATISTICAL_MINIMUM", "BELOW_CONFIGURED_MINIMUM", "BELOW_REQUESTED")) -> DataFrame:
    """A row for each kind of underproduction: how many strata have it, which ones, and how many samples lack."""
    rows = verdicts.where(F.col("verdict").isin(list(over)))
    short = F.sum(F.col("size") - F.coalesce("actual", F.lit(0)))
    return rows.groupBy("verdict").agg(F.count("*").alias("strata"), F.array_join(F.sort_array(F.collect_set(F.col(stratum))), ",").alias("which"), short.alias("lacking"))


def integrity(cells: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, and whether each key is there once."""
    return cells.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).withColumn("intact", F.col("n") == F.col("keys"))


def unstratified_random(cells: DataFrame, n: int, keys: Sequence[str], seed: str) -> DataFrame:
    """Exactly ``n`` cells (all if there are fewer) of lowest hashed rank, with an id that ends in their number."""
    columns = [F.col(k) for k in keys]
    first = cells.withColumns({"_rank": S.rank_column(seed, *columns), "_tie": S.rank_column(seed + "/tie", *columns)}).orderBy("_rank", "_tie", *keys).limit(n)
    rows = first.withColumn("index", F.row_number().over(Window.orderBy("_rank", "_tie", *keys)) - 1)  # n rows
    return rows.withColumn("id", F.concat_ws("_", *(F.col(k).cast("string") for k in keys), "index")).select(*cells.columns, "index", "id")


def origin_phases(df: DataFrame, seed: str, step: str) -> DataFrame:
    """``df`` with the seeded origin of each row's lattice: ``phase_x`` and ``phase_y`` within the ``step`` column, and the whole
    phases ``phase_i`` (of 16) and ``phase_j`` (of 32) that the nested levels are counted from. The same on every run."""
    u = lambda axis: hashing.uniform("origin", F.col(seed), F.lit(axis))
    return df.withColumns({"phase_x": u("x") * F.col(step), "phase_y": u("y") * F.col(step), "phase_i": F.floor(u("i") * 16).cast("int"), "phase_j": F.floor(u("j") * 32).cast("int")})


def lattice_exponent(area: float, n: int, least_distance: float, offset: int = 0, slack: float = 0.75) -> int:
    """Exponent of two of a hexagonal lattice's diameter: about ``n`` points in ``area``, no closer than the least distance."""
    wanted = 0.5 * math.sqrt(8 * area / (3 * math.sqrt(3) * n)) * slack
    return max(math.floor(math.log2(wanted)) - offset, math.ceil(math.log2(least_distance / math.sqrt(3))))


def repair_offsets(counts: DataFrame, base: int = 0, safety: int = 1) -> DataFrame:
    """``(stratum, short, extra, target, repairable)`` of strata ``(stratum, requested, raw, finest)``: how many times denser, in
    powers of two of the diameter, a lattice must be where fewer candidates came out than were asked for.

    Each power quadruples the candidates. A stratum goes no further than its own ``finest`` offset (null: no limit), and one
    that is there already cannot be repaired. No candidates count as one.
    """
    raw = F.greatest(F.coalesce("raw", F.lit(0)), F.lit(1))
    short = F.coalesce("raw", F.lit(0)) < F.col("requested")
    # the least power of four that covers the deficit, in whole numbers
    extra = F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.lit(0), lambda s, k: F.when(raw * F.pow(F.lit(4.0), k) < F.col("requested"), k + 1).otherwise(s))
    limit = F.coalesce("finest", F.lit(1 << 30))
    rows = counts.withColumns({"short": short, "extra": F.when(short, extra).otherwise(0)})
    target = F.when(F.col("short"), F.greatest(F.lit(base), F.least(base + F.col("extra") + safety, limit))).otherwise(base)
    return rows.select("stratum", "short", "extra", target.cast("int").alias("target"), (~F.col("short") | (limit > base)).alias("repairable"))


def repair_offset(offsets: DataFrame) -> DataFrame:
    """One row: the offset of the single repair, the most that any stratum needs, and how many strata it cannot help."""
    return offsets.agg(F.max("target").alias("target"), F.count_if(~F.col("repairable")).alias("beyond_repair"))


def candidates(frame: DataFrame, exponents: DataFrame, stratum: str, finest: int) -> DataFrame:
    """Lattice points of every stratum's own density: ``frame`` has boxes of strata, ``exponents`` (stratum, exponent).

    All lattices are cut out of the finest one, whose diameter is 2 ** finest: a coarser one keeps the points whose row and
    column are multiples of the ratio of diameters, so that lattices nest exactly and no point is made twice.
    """
    points = S.lattice(frame, 2.0**finest)
    ratio = F.pow(F.lit(2.0), F.col("exponent") - finest).cast("long")
    # in the finest lattice, odd rows are shifted by half a column: doubled columns are whole
    doubled = 2 * F.col("i") + F.pmod(F.col("j"), F.lit(2))
    kept = points.join(exponents, stratum).where((F.pmod(F.col("j"), ratio) == 0) & (F.pmod(doubled - F.pmod(F.col("j") / ratio, F.lit(2)) * ratio, 2 * ratio) == 0))
    return kept.withColumns({"j": (F.col("j") / ratio).cast("long"), "i": F.floor(doubled / (2 * ratio))})


def with_metadata(samples: DataFrame, meta: Mapping[str, object], row_level: bool = True) -> DataFrame:
    """The design's parameters on every row, or one JSON text of them in the first column's metadata."""
    import json

    if row_level:
        return samples.withColumns({k: F.lit(v if isinstance(v, str | int | float | bool) else json.dumps(v, sort_keys=True)) for k, v in sorted(meta.items())})
    first = samples.columns[0]
    return samples.withMetadata(first, {"design": json.dumps(dict(meta), sort_keys=True)})


def exact_sample(samples: DataFrame, levels: DataFrame, stratum: str, level: str, sizes: DataFrame, seed: str, keys: Sequence[str]) -> DataFrame:
    """Samples at or above their stratum's chosen level, thinned to its size by a seeded rank (EXACT)."""
    chosen = samples.join(F.broadcast(levels.select(stratum, F.col(level).alias("_least"))), stratum).where(F.col(level) >= F.col("_least"))
    chosen = chosen.join(F.broadcast(sizes.select(stratum, "size")), stratum)
    w = Window.partitionBy(stratum).orderBy(hashing.uniform(seed, *(F.col(k) for k in keys)), *keys)
    return chosen.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("size")).select(*samples.columns)


def sample_classes(pixels: DataFrame, cls: str | None, n: int, keys: Sequence[str], seed: str) -> DataFrame:
    """``n`` pixels of each class, or in all, of lowest hashed rank; masked classes have none."""
    order: list[Column] = [hashing.uniform(seed, *(F.col(k) for k in keys)), *(F.col(k) for k in keys)]
    if cls is None:
        return pixels.orderBy(*order).limit(n)
    w = Window.partitionBy(cls).orderBy(*order)
    return pixels.where(F.col(cls).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select(*pixels.columns)
