"""Operators without SQL, against planted cases, searches and plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import accounts, alerts, ccdc, design, learning, sampling
from gridloom.operators.recipes import Recipes
from gridloom.functions import clouds, verbs


def test_planted_breaks_are_found(spark):
    w = 2 * math.pi / 365.25
    rows = []
    for pixel, at in ((1, None), (2, 1600), (3, 2300)):
        for k, day in enumerate(range(0, 3650, 16)):
            wave = 10 + 3 * math.cos(w * day) + math.sin(2 * w * day) + 0.05 * ((k * 7919 + pixel) % 11 - 5)
            rows.append((pixel, day, wave - (6 if at and day >= at else 0), None if k % 50 == 7 else 1.0))
    obs = spark.createDataFrame(rows, "pixel long, day int, v double, other double")
    # a third of all rows on one pixel and one day changes nothing: days are averaged first
    obs = obs.unionByName(spark.range(700).selectExpr("1L as pixel", "0 as day", f"double({10 + 3 + 0.05 * (1 % 11 - 5)}) as v", "1.0D as other"))
    found = ccdc.fit_segments(obs, "pixel", "day", ["v"], ccdc.Options(penalty=0)).orderBy("pixel", "t_start").collect()
    by = {p: [r for r in found if r.pixel == p] for p in (1, 2, 3)}
    assert [len(by[p]) for p in (1, 2, 3)] == [1, 2, 2]
    assert by[1][0].t_break is None and by[1][0].num_obs == len(range(0, 3650, 16))
    for p, at in ((2, 1600), (3, 2300)):
        first, last = by[p]
        assert at <= first.t_break < at + 32 and abs(first.v_magnitude + 6) < 1 and first.change_prob == 1
        assert last.t_start == first.t_break and last.v_rmse < 0.5
    c = by[1][0].v_coefs
    assert abs(c[0] - 10) < 0.3 and abs(c[2] - 3) < 0.1 and abs(c[5] - 1) < 0.1
    assert ccdc.fit_segments(obs.limit(0), "pixel", "day", ["v"]).collect() == []


def test_chi_square_limit():
    assert abs(ccdc.chi_square_limit(0.99, 1) - 6.6349) < 1e-3
    assert abs(ccdc.chi_square_limit(0.99, 5) - 15.086) < 0.05


def test_sample_size_is_the_least():
    w, p = [0.5, 0.3, 0.2], [0.1, 0.2, 0.4]
    n = design.sample_size(0.2, w, p, 0.95)
    assert design.margin_at(n, w, p, 0.95) <= 0.2 < design.margin_at(n - 1, w, p, 0.95)
    assert design.sample_size(0.2, w, [0.0, 0.0, 0.0], 0.95) is None
    assert design.least_where(lambda x: x * x >= 10**9) == 31623 and design.least_where(lambda x: False, 1, 10) is None


def test_small_rules():
    assert design.smart_round(1234.5) == 1230 and design.smart_round(0.0123456) == 0.0123 and design.smart_round(0) == 0
    assert design.arrangement("GRID", 30) == {"kind": "GRID", "least_distance": 60} and design.arrangement("GRID", 30, 5, {"a": 1})["grid"] == {"a": 1}
    assert design.lattice_exponent(10**6, 100, 1) - design.lattice_exponent(10**6, 1600, 1) == 2


def test_nested_lattices_equal_lattices_made_directly(spark):
    frame = spark.createDataFrame([(1, -40.0, -35.0, 60.0, 55.0)], "stratum int, x0 double, y0 double, x1 double, y1 double")
    places = lambda df: {(round(r.x, 6), round(r.y, 6)) for r in df.collect()}
    finest = places(sampling.lattice(frame, 2.0))
    for exponent in (1, 2, 3):
        sub = design.candidates(frame, spark.createDataFrame([(1, exponent)], "stratum int, exponent int"), "stratum", 1)
        direct = places(sampling.lattice(frame, 2.0**exponent))
        assert places(sub) == direct & finest and len(direct & finest) == len(direct) > 0


def test_levels_nest(spark):
    """A point's level says in which coarser lattice it still is."""
    rows = spark.range(-40, 41).withColumnRenamed("id", "i").crossJoin(spark.range(-40, 41).withColumnRenamed("id", "j"))
    level = {(r.i, r.j): r.level for r in rows.select("i", "j", sampling.lattice_level(F.col("i"), F.col("j")).alias("level")).collect()}
    spots = {(2 * i + j % 2, j): v for (i, j), v in level.items()}
    for n in range(1, 5):
        m = 2**n
        coarse = {(x, y) for x, y in spots if y % m == 0 and (x - (y // m % 2) * m) % (2 * m) == 0}
        assert coarse == {s for s, v in spots.items() if v >= n}


def test_candidates_and_metadata(spark):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    assert design.with_metadata(df, {"seed": 3}, False).schema["id"].metadata == {"design": '{"seed": 3}'}
    assert design.sample_classes(spark.range(100).selectExpr("id", "id % 3 as c"), None, 7, ["id"], "s").count() == 7


def test_recipes_reject_cycles(spark):
    r = Recipes({"a": lambda r: r["b"], "b": lambda r: r["a"], "c": lambda r: spark.range(1)})
    with pytest.raises(ValueError, match="a -> b -> a"):
        r["a"]
    assert r["c"].count() == 1
    with pytest.raises(KeyError):
        r["d"]


def test_verbs(spark):
    df = spark.range(1).selectExpr("id", "1 as red_a", "2 as red_b", "3 as nir_b")
    assert verbs.exclude_bands(df, ["id"], "red", "_b").columns == ["id", "red_a", "nir_b"] and verbs.exclude_bands(df, ["id"]).columns == df.columns
    assert verbs.select_or_default(df, ["id"], ["x", "nir_b"], 5).first() == (0, 5.0, 3)


def test_steps_run_in_their_order(spark):
    seen = []
    step = lambda name: lambda df: (seen.append(name), df)[1]
    clouds.prepared(spark.range(1), {"int16": step("int16"), "snow": step("snow"), "normalize": step("normalize")})
    assert seen == ["normalize", "snow", "int16"]
    with pytest.raises(ValueError):
        clouds.prepared(spark.range(1), {"other": step("other")})


def test_masked_pixels_stay(spark):
    train = spark.createDataFrame([(float(i), float(i % 2), i % 2) for i in range(20)], "a double, b double, label int")
    pixels = spark.createDataFrame([(1, 1.0, 0.0), (2, None, 1.0), (3, 2.0, 1.0)], "id int, a double, b double")
    out = {r.id: r["class"] for r in learning.classify(train, pixels, ["a", "b"], "label", "CART").collect()}
    assert out[2] is None and out[1] == 0 and out[3] == 1
    assert {r.id: r.regression for r in learning.regress(train, pixels, ["a", "b"], "label", "CART").collect()}[2] is None
    assert {r.id: r.cluster for r in learning.cluster(pixels, ["a", "b"], 2).collect()}[2] is None


def test_places_and_kept_alerts(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as k")
    got = [(r.k, r.id) for r in sorted(accounts.placed(df, ["k", "id"]).collect(), key=lambda r: r.place)]
    assert got == sorted(got) and len(got) == 100
    rows = spark.createDataFrame([(1, 5, 3, 9), (2, 1, 3, 9), (3, 5, 9, 9), (4, None, 1, 2)], "pixel int, confirmation int, last_stable int, last_detection int")
    assert [r.pixel for r in alerts.kept_alerts(rows, F.lit(4)).collect()] == [1]


def test_changes_across_micro_batches(spark, tmp_path):
    from gridloom.streaming import state

    rows = [(1, "a", 1), (1, "a", 2), (2, "x", 1), (1, "b", 3), (2, "x", 2), (3, None, 1), (1, "b", 4), (2, "y", 3), (1, "a", 5)]
    for n in range(0, 9, 3):
        spark.createDataFrame(rows[n : n + 3], "k long, s string, t long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("k long, s string, t long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = sorted((r.k, r.t) for r in state.changes_now(stream, "k", "s", ["t"]).collect())
    assert got == [(1, 1), (1, 3), (1, 5), (2, 1), (2, 3), (3, 1)]


def test_origin_phases_are_seeded(spark):
    df = spark.createDataFrame([("s", 10.0), ("t", 10.0), ("s", 10.0)], "seed string, step double")
    a, b, c = (tuple(r)[2:] for r in design.origin_phases(df, "seed", "step").collect())
    assert a == c != b and all(0 <= p < 10 for p in (*a[:2], *b[:2])) and all(0 <= r[2] < 16 and 0 <= r[3] < 32 for r in (a, b))


def test_repair_offsets(spark):
    rows = [("enough", 100, 100, None), ("four", 100, 25, None), ("more", 100, 24, None), ("none", 100, 0, None), ("null", 100, None, None), ("near", 100, 1, 2), ("stuck", 100, 1, 0)]
    found = design.repair_offsets(spark.createDataFrame(rows, "stratum string, requested int, raw int, finest int"))
    got = {r.stratum: (r.short, r.extra, r.target, r.repairable) for r in found.collect()}
    assert got == {
        "enough": (False, 0, 0, True), "four": (True, 1, 2, True), "more": (True, 2, 3, True), "none": (True, 4, 5, True), "null": (True, 4, 5, True), "near": (True, 4, 2, True), "stuck": (True, 4, 0, False),
    }
    assert tuple(design.repair_offset(found).first()) == (5, 1)


def test_rescan_delays(spark):
    from gridloom.operators import accounts

    # size, active: change, twice the same, at the most whatever the size, active again, same
    rows = [(1, i, s, a) for i, (s, a) in enumerate([(5, False), (5, False), (5, False), (5, False), (7, False), (7, True), (7, False), (8, False)])]
    out = accounts.rescan_delay(spark.createDataFrame(rows, "user int, i int, size int, active boolean"), "user", ["i"], "size", "active", 2.0, 10.0, 60.0)
    assert [r.delay for r in out.orderBy("i").collect()] == [10, 20, 40, 60, 60, 10, 20, 10]
