"""Chains over segments, samples and classes, on segments made by hand."""

from pyspark.sql import functions as F

from gridloom.operators.find import Find, classified, sampled

ROWS = [(1, 0.0, 10.0, 5.0, None), (1, 20.0, 30.0, 9.0, 2.0), (1, 40.0, 50.0, 9.0, None), (1, 60.0, 70.0, 1.0, 4.0), (2, 0.0, 5.0, None, None)]


def segments(spark):
    return spark.createDataFrame(ROWS, "pixel int, t_start double, t_end double, a double, b double")


def of(df):
    return {r.pixel: (r.t_start, r.a, r.b) for r in df.collect()}


def test_picks(spark):
    find = Find(segments(spark), "pixel")
    # bands are picked each for itself, the last of equal extremes counts
    assert of(find.first()) == {1: (0.0, 5.0, 2.0), 2: (0.0, None, None)}
    assert of(find.last()) == {1: (60.0, 1.0, 4.0), 2: (0.0, None, None)}
    assert of(find.max("a")) == {1: (40.0, 9.0, 2.0), 2: (None, None, None)}
    assert of(find.min("a")) == {1: (60.0, 1.0, 4.0), 2: (None, None, None)}
    masked = find.add_bands(c=F.col("t_end") / 2, a=-F.col("a")).update_mask(F.col("t_start") < 50)
    assert of(masked.max("a")) == {1: (0.0, -5.0, None), 2: (None, None, None)}
    assert [r.c for r in masked.last().orderBy("pixel").collect()] == [25.0, 2.5]
    assert Find(segments(spark).limit(0), "pixel").first().collect() == []


def test_samples_and_classes(spark):
    points = spark.createDataFrame([("p", 1, 5, 1), ("q", 1, 15, 2), ("r", 1, 20, 2), ("s", 9, 5, 1), ("t", 1, 65, 1)], "name string, pixel int, day int, cls int")
    bands = {"double_a": 2 * F.col("a")}
    got = {r.name: (r.cls, r.double_a) for r in sampled(points, segments(spark), "pixel", "day", bands).collect()}
    assert got == {"p": (1, 10.0), "r": (2, 18.0), "t": (1, 2.0)}
    train = spark.createDataFrame([(float(x), int(x > 12)) for x in range(40)], "double_a double, cls int")
    types = {(r.pixel, r.t_start): r.type for r in classified(train, segments(spark), bands, "cls", "CART").collect()}
    assert types == {(1, 0.0): 0, (1, 20.0): 1, (1, 40.0): 1, (1, 60.0): 0, (2, 0.0): None}


def test_points_without_segments_and_repeated_auxiliaries(spark):
    from gridloom.operators import segments as S
    from gridloom.sources import scenes

    points = spark.createDataFrame([(1,), (7,)], "pixel int")
    got = {r.pixel: (r.starts, r.values) for r in S.at_points(segments(spark), points, "pixel", {"t_start": "starts", "b": "values"}).collect()}
    assert got == {1: ([0.0, 20.0, 40.0, 60.0], [0.0, 2.0, 0.0, 4.0]), 7: ([], [])}
    own = spark.createDataFrame([(1, "a"), (2, "b")], "scene int, name string")
    other = spark.createDataFrame([(1, 5.0), (1, 3.0)], "scene int, cloud double")
    assert sorted(tuple(r) for r in scenes.linked(own, other, ["cloud"]).collect()) == [(1, "a", 3.0), (2, "b", None)]
