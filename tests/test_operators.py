"""Operators against golden cases and plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import bits, harmonics, masks
from gridloom.operators import alerts, catalog, composite, filters, learning, sampling, segments
from gridloom.sources import tables


def test_dynamic_equality(spark):
    df = spark.createDataFrame([("8", 8.0), ("08", 0.0), ("forest", 1.5), ("0", None)], "s string, n double")
    count = lambda c: df.where(c).count()
    eq = lambda n, v: count(filters.equals(df, n, v))
    assert [eq("s", v) for v in ("8", "08", "forest", "", 8, None, False)] == [1, 1, 1, 0, 2, 0, 0]
    assert [eq("n", v) for v in ("8", "08", "0", 8, 0, "forest", "  ", None)] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert count(filters.in_list(df, "s", [])) == 0 and count(filters.in_list(df, "s", ["8", "forest"])) == 2


def test_constraints(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        filters.constraint(F.col("id"), "~", 1)
    both = {"property": "id", "constraints": [{"op": ">", "value": 2}, {"op": "range", "low": 0, "high": 5, "high_inclusive": True}]}
    assert [r.id for r in df.where(filters.property_filter([both])).collect()] == [3, 4, 5]
    none = {"band": "id", "all": False, "constraints": []}
    assert df.where(filters.pixel_mask([none])).count() == 0
    assert df.where(filters.pixel_mask([none | {"all": True}])).count() == 10
    wide = {"band": "id", "constraints": [{"op": "=", "value": 3, "from_bit": 1, "to_bit": 1, "from_inclusive": False}]}
    assert [r.id for r in df.where(filters.pixel_mask([wide])).collect()] == [3, 7]


def test_mask_truth_table(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean")
    out = df.select("a", "b", masks.both(F.col("a"), F.col("b")).alias("x"), masks.either(F.col("a"), F.col("b")).alias("y")).collect()
    for r in out:
        known = r.a is not None and r.b is not None
        assert r.x == ((r.a and r.b) if known else None) and r.y == ((r.a or r.b) if known else None)


def test_bits(spark):
    r = spark.sql("select 203L as v").select(bits.field(F.col("v"), 3).alias("a"), bits.field(F.col("v"), 6, 7).alias("b"), bits.parity(F.lit(-5)).alias("c")).first()
    assert tuple(r) == (1, 3, 1)


def test_composites_on_empty_and_ties(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 7, 3), (1, 7, 4), (2, None, 1)], "pixel int, v int, t int")
    assert composite.mode(df, ["pixel"], "v").collect() == [(1, 5)]
    assert dict(composite.mosaic(df, ["pixel"], ["v"], ["t"]).collect()) == {1: 7, 2: None}
    assert composite.composite(df.limit(0), ["pixel"], ["v"], "MEDIAN").collect() == []
    with pytest.raises(KeyError):
        composite.composite(df, ["pixel"], ["v"], "NOPE")


@pytest.mark.parametrize(("args", "want"), [((10, [0.5, 0.5], "EQUAL"), [5, 5]), ((10, [0.25] * 4, "EQUAL"), [3, 3, 2, 2]), ((100, [0.1, 0.9]), [10, 90]), ((99, [0.1, 0.9]), [10, 89])])
def test_allocation(args, want):
    assert sampling.allocate(*args) == want


def test_allocation_minimum():
    assert sampling.allocate(20, [0.01, 0.99], least=5) == [5, 15]
    with pytest.raises(ValueError):
        sampling.allocate(5, [0.5, 0.5], least=3)
    assert sum(sampling.allocate(50, [0.2, 0.3, 0.5], "OPTIMAL", [0.1, 0.5, 0.9])) == 50


def test_confidence():
    low, p, high = sampling.confidence_bounds([(0.2, 0.6, 100), (0.8, 0.1, 30)], 0.95)
    assert (low, p, high) == (pytest.approx(0.137460746, abs=1e-8), pytest.approx(0.2), pytest.approx(0.342687125, abs=1e-8))
    assert sampling.margin_of_error(0.1, 0.2, 0.35) == pytest.approx(0.75) and sampling.margin_of_error(0, 0, 0) == math.inf


def test_lattice_levels(spark):
    points = [(0, 0), (8, 16), (2, 4), (1, 3)]
    df = spark.createDataFrame(points, "i long, j long").select(sampling.lattice_level(F.col("i"), F.col("j")).alias("v"))
    assert [r.v for r in df.collect()] == [4.5, 4.0, 2.0, 0.0]
    grid = spark.range(-16, 32).select(F.col("id").alias("i")).join(spark.range(-32, 64).select(F.col("id").alias("j")))
    level = sampling.lattice_level(F.col("i"), F.col("j"))
    shifted = sampling.lattice_level(F.col("i") + 16, F.col("j") + 32)
    assert grid.where(level != shifted).count() == 0 and grid.where((F.pmod("j", F.lit(2)) == 1) & (level != 0)).count() == 0


def test_random_draw_is_independent_of_the_threshold(spark):
    cells = spark.range(5000).select((F.col("id") % 3).alias("s"), F.col("id").alias("cell"))
    sizes = spark.createDataFrame([(0, 100), (1, 5), (2, 5000)], "s long, size int")
    got = {}
    for r in sampling.stratified_random(cells, "s", sizes, ["cell"], "x").collect():
        got.setdefault(r.s, set()).add(r.cell)
    assert {k: len(v) for k, v in got.items()} == {0: 100, 1: 5, 2: 1666}
    ranks = cells.withColumn("r", sampling.rank_column("x", F.col("cell"))).where("s = 0").orderBy("r").limit(100)
    assert got[0] == {r.cell for r in ranks.collect()}


def test_instance_spending(spark):
    uses = spark.sql(
        """select * from values ('a', 'x', timestamp_ntz'2020-02-01 00:00', timestamp_ntz'2020-02-01 02:00'), ('b', 'x', timestamp_ntz'2020-02-01 00:00', timestamp_ntz'2020-02-01 00:06'),
        ('c', 'x', timestamp_ntz'2020-02-01 00:00', timestamp_ntz'2020-02-01 01:06'), ('d', 'x', timestamp_ntz'2020-01-01 00:00', timestamp_ntz'2020-01-02 00:00'),
        ('e', 'x', timestamp_ntz'2020-01-31 23:00', timestamp_ntz'2020-02-01 01:00'), ('f', 'unknown', timestamp_ntz'2020-02-03 00:00', timestamp_ntz'2020-02-04 00:00') as t(user, type, start, end)"""
    )
    prices = spark.createDataFrame([("x", 3.0)], "type string, price double")
    got = {r.user: r.spending for r in catalog.instance_spending(uses, prices, "2020-02-01", "2020-03-01").collect()}
    assert got == {"a": 6, "b": 3, "c": 6, "d": 0, "e": 3, "f": 0}


def test_greedy_cover(spark):
    rows = [(1, s, c, cl) for s, cs, cl in (("full", range(4), 0), ("half", range(2), 0), ("cloudy", range(4), 75)) for c in cs]
    got = catalog.cover_scenes(spark.createDataFrame(rows, "area int, scene string, cell int, cloud int"), "area", "scene", "cell", "cloud").collect()
    assert [(r.scene, r.gain) for r in got] == [("full", 1.0)]


def test_segment_lookup(spark):
    seg = spark.createDataFrame([(1, 0.0, 10.0), (1, 20.0, 30.0)], "pixel int, t_start double, t_end double")
    at = spark.createDataFrame([(1, -5.0), (1, 5.0), (1, 12.0), (1, 18.0), (1, 35.0), (2, 1.0)], "pixel int, t double")
    pick = lambda how: {(r.pixel, r.t): r.t_start for r in segments.lookup(seg, at, "pixel", how, ["t_start"]).collect()}
    assert pick("mask") == {(1, -5.0): None, (1, 5.0): 0.0, (1, 12.0): None, (1, 18.0): None, (1, 35.0): None, (2, 1.0): None}
    assert pick("previous") == {(1, -5.0): None, (1, 5.0): 0.0, (1, 12.0): 0.0, (1, 18.0): 0.0, (1, 35.0): 20.0, (2, 1.0): None}
    assert pick("next") == {(1, -5.0): 0.0, (1, 5.0): 0.0, (1, 12.0): 20.0, (1, 18.0): 20.0, (1, 35.0): None, (2, 1.0): None}
    assert pick("closest")[1, 18.0] == 20.0 and pick("closest")[1, 12.0] == 0.0 and pick("closest")[1, 35.0] == 20.0


def test_harmonic_mean_is_the_integral(spark):
    coefs = [1.0, 0.01, 0.5, -0.3, 0.2, 0.1, 0.05, -0.2]
    df = spark.sql("select array(" + ",".join(f"double({c})" for c in coefs) + ") as c")
    steps = 20000
    exact = df.select(harmonics.mean(F.col("c"), F.lit(100.0), F.lit(400.0)).alias("m")).first().m
    points = df.join(spark.range(steps)).select(F.avg(harmonics.value(F.col("c"), 100 + (F.col("id") + 0.5) * (300 / steps))).alias("m")).first().m
    assert exact == pytest.approx(points, abs=1e-6)


def test_bayesian_alerts(spark):
    rows = [(1, t, p, 1) for t, p in enumerate([0.1, 0.9, 0.9, 0.95, 0.1])] + [(2, t, 0.2, 1) for t in range(4)] + [(3, 0, None, 1)]
    df = spark.createDataFrame(rows, "pixel int, k long, pnf double, orbit long").withColumn("ts", F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, k)")).select("pixel", "ts", "pnf", "orbit")
    got = {r.pixel: r for r in alerts.bayesian_alerts(df, "pixel", ["ts"], "pnf", "orbit").collect()}
    assert set(got) == {1, 2} and got[1].flag == 2 and got[1].first_detection.day == 2 and (got[2].flag, got[2].p) == (0, 0.0)


def test_rules_and_cluster(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 50, 51, 100, 101)], "f double")
    assert [r.c for r in df.select(learning.rules({"test": "f > 60", "yes": 1, "no": {"test": "f > 10", "yes": 2, "no": 3}}).alias("c")).collect()] == [3, 3, 2, 2, 1, 1]
    assert [r.cluster for r in learning.cluster(df, ["f"], 3).orderBy("f").collect()] == [0, 0, 1, 1, 2, 2]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (2, "c", 1)], "id int, name string, t int")
    df.write.option("header", "true").option("compression", "gzip").csv(f"{tmp_path}/csv")
    assert sorted(tables.ingest_csv(spark, f"{tmp_path}/csv", df.schema, ["id"], ["t"]).collect()) == [(1, "b", 3), (2, "c", 1)]
    with pytest.raises(ValueError):
        tables.asset(spark, f"{tmp_path}/csv", "tiff")
    tables.export_tiles(df.where("id = 1"), f"{tmp_path}/tiles", "id", resume=True)
    tables.export_tiles(df, f"{tmp_path}/tiles", "id", resume=True)
    assert spark.read.parquet(f"{tmp_path}/tiles").count() == 3
    tables.export_tiles(df, f"{tmp_path}/tiles", "id")
    assert spark.read.parquet(f"{tmp_path}/tiles").count() == 3
    tables.export_csv(df.select("id", F.struct("name").alias("s")), f"{tmp_path}/out")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/out").where("s = '{\"name\":\"a\"}'").count() == 1


def test_harmonic_regression(spark):
    import numpy as np

    from gridloom.operators import fitting

    rng = np.random.default_rng(1)
    t = rng.uniform(0, 3, 60)
    y = 2 + 0.5 * t + 1.5 * np.cos(2 * np.pi * t) - 0.7 * np.sin(2 * np.pi * t)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, y)] + [(2, 0.5, 3.0)], "pixel int, t double, y double")
    got = {r.pixel: r for r in fitting.harmonic_regression(df, "pixel", F.col("t"), "y").collect()}
    assert [got[1][n] for n in fitting.NAMES] == pytest.approx([2, 0.5, 1.5, -0.7], abs=1e-6)
    assert got[1].amplitude == pytest.approx(math.hypot(1.5, 0.7)) and got[1].rmse < 1e-5 and got[2].rmse == pytest.approx(0, abs=1e-6)


def test_unmixing(spark):
    import numpy as np

    from gridloom.functions import indexes
    from gridloom.operators import fitting

    ends = np.array(list(indexes.ENDMEMBERS.values()))
    rng = np.random.default_rng(2)
    true = rng.dirichlet(np.ones(5), 50)
    assert np.abs(fitting.unmix(true @ ends, ends) - true).max() < 1e-6
    wild = rng.uniform(-1, 2, (200, 6))
    found = fitting.unmix(wild, ends)
    assert (found >= 0).all() and np.abs(found.sum(1) - 1).max() < 1e-6
    error = ((found @ ends - wild) ** 2).sum(1)
    other = rng.dirichlet(np.ones(5), 3000)
    assert all(error[i] <= ((other @ ends - wild[i]) ** 2).sum(1).min() + 1e-9 for i in range(200))
    df = spark.createDataFrame([(1, *map(float, true[0] @ ends)), (2, None, 0.1, 0.1, 0.1, 0.1, 0.1)], "id int, " + ", ".join(f"{b} double" for b in indexes.BANDS))
    got = {r.id: r.ndfi for r in fitting.degradation_index(df).collect()}
    assert got[2] is None and -1 <= got[1] <= 1
