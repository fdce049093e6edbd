"""Scene collections of several data sets: optical, radar and planet sources over tables of observations.

A data set is a DataFrame with the keys ``scene``, ``ts`` and a pixel, and its bands under common names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import verbs

#: Data sets that a source's name stands for (fixed values).
ALIASES = {
    "LANDSAT_9": ["LANDSAT_9"],
    "LANDSAT_8": ["LANDSAT_8"],
    "LANDSAT_7": ["LANDSAT_7"],
    "LANDSAT_TM": ["LANDSAT_4", "LANDSAT_5"],
    "SENTINEL_2": ["SENTINEL_2"],
}


def data_sets(sources: Sequence[str], tier2: bool = False) -> list[str]:
    """Data sets of source names, each followed by its second tier if wanted (names ending in _T2)."""
    out: list[str] = []
    for source in sources:
        base = source.removesuffix("_T2")
        for name in ALIASES.get(base, [base]):
            out += [name] if source == base else []
            out += [f"{name}_T2"] if tier2 or source != base else []
    return list(dict.fromkeys(out))


def aliased(df: DataFrame, source: str, tier2: Column) -> DataFrame:
    """``df`` with a row for each data set that its source name stands for (``data_set``), as ``data_sets`` names them."""
    first = F.regexp_replace(source, "_T2$", "")
    named = F.create_map(*(x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    base = F.coalesce(F.element_at(named, first), F.array(first))
    second = F.transform(base, lambda x: F.concat(x, F.lit("_T2")))
    own = F.when(F.endswith(F.col(source), F.lit("_T2")), second).when(tier2, F.array_distinct(F.concat(base, second))).otherwise(base)
    return df.withColumn("data_set", F.explode(own))


def all_scenes(sets: Mapping[str, DataFrame], names: Sequence[str], keys: Sequence[str], start: str, end: str, cloud: Mapping[str, str] | None = None, most_cloud: float = 100) -> DataFrame:
    """The observations of several data sets in ``[start, end)`` over their common bands.

    ``cloud`` names the column of each data set that holds its cloud cover; at ``most_cloud`` 100 nothing is filtered.
    The column counts as metadata, not as a band.
    """
    frames = []
    for name in names:
        df = sets[name].where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
        column = (cloud or {}).get(name)
        if column:
            df = (df if most_cloud >= 100 else df.where(F.col(column) <= most_cloud)).drop(column)
        frames.append(df.withColumn("data_set", F.lit(name)))
    return verbs.union_common(frames, [*keys, "data_set"])


def selected_scenes(sets: Mapping[str, DataFrame], chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The observations of chosen scenes ``(data_set, scene)`` over the common bands of their data sets.

    ``chosen`` names each data set's scenes; its join is a semi join, so that repeated names change nothing.
    """
    frames = [df.withColumn("data_set", F.lit(name)).join(chosen.where(F.col("data_set") == name).select("scene"), "scene", "left_semi") for name, df in sets.items()]
    return verbs.union_common(frames, [*keys, "data_set"])


def has_imagery(df: DataFrame) -> DataFrame:
    """One row: whether there is any observation. One row at most is read."""
    return df.limit(1).agg((F.count("*") > 0).alias("has_imagery"))


def linked(scenes: DataFrame, auxiliary: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Scenes with bands of the auxiliary scene of the same name, the first (by its bands' order) where it repeats; masked where there is none."""
    first = auxiliary.groupBy("scene").agg(F.min(F.struct(*bands)).alias("_first"))
    return scenes.join(first, "scene", "left").select(*scenes.columns, *(F.col("_first")[b].alias(b) for b in bands))


def first_tile(scenes: DataFrame, tiles: DataFrame, tile: str, name: str, columns: Sequence[str]) -> DataFrame:
    """Scenes with columns of the first tile (by its own columns' order) of their tile's name; scenes without one go."""
    first = tiles.groupBy(F.col(name).alias("_tile")).agg(F.min(F.struct(*columns)).alias("_first"))
    return scenes.join(first, F.col(tile) == F.col("_tile")).select(*scenes.columns, *(F.col("_first")[c].alias(c) for c in columns))


def radar_scenes(df: DataFrame, orbits: Sequence[str], mode: str = "IW", polarisations: Sequence[str] = ("VV", "VH")) -> DataFrame:
    """Scenes of an instrument mode that have all polarisations (an array column) and fly in one of the orbit directions."""
    kept = df.where(F.col("mode") == mode)
    for p in polarisations:
        kept = kept.where(F.array_contains("polarisations", p))
    return kept.where(F.col("orbit").isin(*orbits))


def orbit_lookup(images: DataFrame, stats: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Images with the first row of statistics (by its columns) of the same orbit direction and relative orbit."""
    first = stats.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_first"))
    return images.join(first, list(keys), "left").select(*images.columns, *(F.col("_first")[c].alias(c) for c in columns))


def corrected_if_found(images: DataFrame, factors: DataFrame, keys: Sequence[str], band: str, factor: str) -> DataFrame:
    """``band`` times its factor by keys, where one is found; others stay as they are."""
    first = factors.groupBy(*keys).agg(F.min(factor).alias("_factor"))
    out = images.join(first, list(keys), "left")
    return out.withColumn(band, F.when(F.col("_factor").isNotNull(), F.col(band) * F.col("_factor")).otherwise(F.col(band))).drop("_factor")


def daily_planet(df: DataFrame, layouts: Mapping[str, Mapping[str, str]], qa: Mapping[str, str]) -> DataFrame:
    """Union of band layouts (a column ``layout``): bands renamed, ``udm1`` from the layout's quality column, or 0."""
    out = None
    for layout, bands in layouts.items():
        rows = df.where(F.col("layout") == layout)
        udm = F.col(qa[layout]) if layout in qa else F.lit(0)
        part = rows.select("scene", "ts", "pixel", *(F.col(b).alias(n) for b, n in bands.items()), udm.cast("int").alias("udm1"))
        out = part if out is None else out.unionByName(part)
    return out


def centred(df: DataFrame, key: str, order: str, mid, n: int) -> DataFrame:
    """Up to ``2 n`` rows of each key around a middle: the n nearest before it and after it, and where one side has too
    few, more of the other."""
    after = F.col(order) >= mid
    w = Window.partitionBy(key, "_after").orderBy(F.when(F.col("_after"), F.col(order)), F.when(~F.col("_after"), F.col(order)).desc())
    rows = df.withColumn("_after", after).withColumn("_rank", F.row_number().over(w))
    side = Window.partitionBy(key)
    rows = rows.withColumns({"_b": F.sum((~F.col("_after")).cast("int")).over(side), "_a": F.sum(F.col("_after").cast("int")).over(side)})
    before_take = n + F.greatest(F.lit(0), n - F.col("_a"))
    after_take = n + F.greatest(F.lit(0), n - F.col("_b"))
    return rows.where(F.col("_rank") <= F.when(F.col("_after"), after_take).otherwise(before_take)).drop("_after", "_rank", "_a", "_b")


def clipped(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose place lies in a box (x0, y0, x1, y1), its edges included: a filter that reaches the scan."""
    x0, y0, x1, y1 = box
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
