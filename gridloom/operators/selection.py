"""Greedy selection of scenes for areas, in Spark rounds: each round picks a scene for every area that can be decided at once.

No area is gathered in a task: gains are grouped sums, picks maxima, and what cells have so far is a table that each round writes
anew. The number of rounds is that of the picks, not of the scenes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Rows up to which a round's picks are broadcast: an area has one at most.
FEW = 500_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _unique(df: DataFrame) -> DataFrame:
    """A side whose keys do not repeat: broadcast if it is small, else hashed in its partition, so that the longer side is not sorted."""
    few = _small(df)
    return few if few is not df else df.hint("shuffle_hash")


def cover_scenes(rows: DataFrame, area: str, scene: str, cell: str, cloud: str, least_gain: float = 0.0, most: int = 10, least: int = 0, enough: float = 1.0) -> DataFrame:
    """Greedy cover of each area's cells: in turn the scene that adds most coverage, clouded cells counting in part.

    ``(area, scene, rank, gain)``. ``rows`` has a row for each cell of each scene (of repeated ones the clearest counts). An area ends
    with ``most`` scenes, when none gains more than ``least_gain``, or when it has ``least`` and is covered to the share ``enough``.
    Ties go to the smaller scene. Masked clouds add nothing. Each round goes over the rows that can still add something.
    """
    given = rows.select(F.col(area).alias("area"), F.col(scene).alias("scene"), F.col(cell).alias("cell"), (1 - F.col(cloud) / 100).alias("clear")).where("clear is not null and area is not null and cell is not null")
    # a scene's rows lie together, so that its gains are summed before they are shuffled
    given = given.repartition("area", "scene").groupBy("area", "scene", "cell").agg(F.max("clear").alias("clear"))
    left = staged(given.withColumn("have", F.lit(0.0)), "cover")
    size = staged(left.select("area", "cell").distinct().groupBy("area").agg(F.count("*").alias("n")), "cover-areas")
    out, cells = None, None
    for rank in range(1, most + 1):
        gains = left.groupBy("area", "scene").agg(F.sum(F.greatest(F.col("clear") - F.col("have"), F.lit(0.0))).alias("sum"))
        gains = gains.join(_unique(size), "area").select("area", "scene", F.round(F.col("sum") / F.col("n"), 12).alias("gain")).where(F.col("gain") > least_gain)
        first = F.min_by(F.struct("gain", "scene"), F.struct(-F.col("gain"), F.col("scene")))
        picks = staged(gains.groupBy("area").agg(first.alias("b")).select("area", F.col("b.scene").alias("scene"), F.lit(rank).alias("rank"), F.col("b.gain").alias("gain")), "cover-picks")
        if picks.isEmpty():
            break
        out = picks if out is None else out.unionByName(picks)
        if rank == most:
            break
        taken = left.where("clear > have").join(_unique(picks.select("area", "scene")), ["area", "scene"]).select("area", "cell", F.col("clear").alias("now"))
        taken = staged(taken, "cover-taken")
        cells = taken if cells is None else cells.unionByName(taken)
        if least_gain < 0:  # scenes that add nothing are picked as well
            left = left.join(_unique(picks.select("area", "scene")), ["area", "scene"], "left_anti")
        if rank >= least:
            covered = cells.groupBy("area", "cell").agg(F.max("now").alias("now")).groupBy("area").agg(F.sum("now").alias("sum"))
            full = staged(covered.join(_unique(size), "area").where(F.col("sum") / F.col("n") >= enough).select("area"), "cover-full")
            left = left.join(_unique(full), "area", "left_anti")
        left = left.join(_unique(taken), ["area", "cell"], "left").select("area", "scene", "cell", "clear", F.greatest("have", "now").alias("have"))
        if least_gain >= 0:  # what a cell has never falls: a row that adds nothing now adds nothing later, the picked scene's neither
            left = left.where("clear > have")
        left = staged(left, "cover")
    if out is None:
        kinds = dict(given.dtypes)
        return rows.sparkSession.createDataFrame([], f"`{area}` {kinds['area']}, `{scene}` {kinds['scene']}, rank int, gain double")
    return out.select(F.col("area").alias(area), F.col("scene").alias(scene), "rank", F.round("gain", 6).alias("gain"))


def layers(cells: DataFrame, most: int = 1_000) -> DataFrame:
    """``(area, layer)``: areas that share a cell lie in different layers, the smaller one in the earlier.

    Taking layer after layer, all areas of one at once, gives what taking all areas in their order would give. A layer follows
    the longest chain of smaller neighbours; more than ``most`` raise.
    """
    with_area = cells.select("area", "cell").distinct()
    shared = with_area.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    # the next larger area of each cell is enough: chains run through it
    ahead = with_area.join(shared, "cell", "left_semi").withColumn("after", F.lead("area").over(Window.partitionBy("cell").orderBy("area")))
    links = staged(ahead.where("after is not null").select("area", "after").distinct(), "layer-links")
    found = staged(with_area.select("area").distinct().withColumn("layer", F.lit(0)), "layers")
    for _ in range(most):
        pushed = links.join(_small(found), "area").groupBy(F.col("after").alias("_a")).agg((F.max("layer") + 1).alias("_l"))
        moved = staged(found.join(_small(staged(pushed, "layer-pushed")), F.col("area") == F.col("_a"), "left").select("area", F.greatest("layer", F.coalesce("_l", F.lit(0))).alias("layer"), (F.coalesce("_l", F.lit(0)) > F.col("layer")).alias("_m")), "layers")
        if moved.where("_m").isEmpty():
            return found
        found = moved.drop("_m")
    raise RuntimeError(f"areas form chains of more than {most}")


def round_robin(rows: DataFrame, area: str, scene: str, cell: str, cloud: str, target: float, most: int = 1_000) -> DataFrame:
    """Areas take turns: each picks the scene that adds most, ``(100 - cloud)`` times the cells not yet covered, until none adds anything.

    ``(area, scene, rank)``. A cell, which several areas may hold, is covered once the product of the cloud shares of the scenes picked
    over it falls under ``target`` (a share). Areas come in their order in each turn, and one that adds nothing leaves; ties go to the
    smaller scene. ``rows`` has a row for each cell of each scene of an area, with the scene's cloud percentage, and repeated rows
    count once; masked clouds never add. ``most`` bounds the turns; it must not be reached.
    """
    given = rows.select(F.col(area).alias("area"), F.col(scene).alias("scene"), F.col(cell).alias("cell"), F.col(cloud).cast("double").alias("cloud"))
    given = staged(given.where("cloud is not null and area is not null and cell is not null").distinct(), "robin")
    layer = staged(layers(given), "robin-layers")
    turns = [r["layer"] for r in layer.select("layer").distinct().orderBy("layer").collect()]
    state = staged(given.select("cell").distinct().withColumn("clouds", F.lit(1.0)), "robin-cells")
    active, picked = layer, None
    for rank in range(1, most + 1):
        if not turns:
            break
        stay = []
        for turn in turns:
            now = active.where(F.col("layer") == turn).select("area")
            left = given.join(_small(now), "area", "left_semi")
            if picked is not None:
                left = left.join(picked.select("area", "scene"), ["area", "scene"], "left_anti")
            uncovered = state.where(F.col("clouds") >= target)
            gains = left.join(uncovered.select("cell"), "cell", "left_semi").groupBy("area", "scene").agg(F.max("cloud").alias("cloud"), F.count("*").alias("n"))
            gains = gains.withColumn("gain", (100 - F.col("cloud")) * F.col("n")).where("gain > 0")
            best = F.min_by(F.struct("scene", "cloud"), F.struct(-F.col("gain"), F.col("scene")))
            picks = staged(gains.groupBy("area").agg(best.alias("b")).select("area", "b.*", F.lit(rank).alias("rank")), "robin-picks")
            if picks.isEmpty():
                continue
            stay.append(turn)
            hit = left.join(_small(picks.select("area", "scene")), ["area", "scene"]).select("cell", F.col("cloud").alias("_c"))
            more = F.when(F.col("_c").isNotNull() & (F.col("clouds") >= target), F.col("_c") / 100).otherwise(1.0)
            state = staged(state.join(hit, "cell", "left").select("cell", (F.col("clouds") * more).alias("clouds")), "robin-cells")
            picked = picks if picked is None else picked.unionByName(picks)
        turns = stay
        if turns:
            last = picked.where(F.col("rank") == rank).select("area")
            active = staged(active.join(_small(last), "area", "left_semi"), "robin-active")
            picked = staged(picked, "robin-picked")
    else:
        raise RuntimeError(f"not settled in {most} turns")
    if picked is None:
        kinds = dict(given.dtypes)
        return rows.sparkSession.createDataFrame([], f"`{area}` {kinds['area']}, `{scene}` {kinds['scene']}, rank int")
    return picked.select(F.col("area").alias(area), F.col("scene").alias(scene), "rank")
