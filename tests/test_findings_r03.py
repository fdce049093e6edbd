"""What the third round of findings was about."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import accounts, alerts, ccdc, design, matching, selection, tiles
from gridloom.plans import bayts as bayts_plans
from gridloom.plans import change
from gridloom.registry import ORACLE_SQL
from gridloom.streaming import state

SF = "/root/testdata/sf0.001"


def test_places_when_the_ranges_are_sampled(spark):
    """more rows than the sample that bounds the ranges takes; a column that is not sorted by must not matter."""
    df = spark.range(0, 400_000, 1, 8).select("id", (F.xxhash64("id") % 25).alias("k"), F.col("id").cast("string").alias("name"))
    out = accounts.placed(df, ["k", "id"])
    assert sorted(r.place for r in out.select("place", "name").collect()) == list(range(1, 400_001))
    before = out.select("place", F.struct("k", "id", "name").alias("at"))
    after = before.select((F.col("place") - 1).alias("place"), F.col("at").alias("next"))
    assert before.join(after, "place").where("at >= next").count() == 0


def test_stream_of_many_files_has_no_late_observation(spark, monkeypatch):
    """one file to a micro-batch, several files."""
    read = state.read_staged
    monkeypatch.setattr(state, "read_staged", lambda rows: read(rows, 1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = bayts_plans.stream_bayts(spark, SF).collect()
        want = bayts_plans.bayts_monitoring(spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.late for r in got) == 0
    assert sorted(tuple(r)[:-1] for r in got) == sorted(tuple(r) for r in want)


def test_a_lasso_that_descends_slowly_is_solved():
    """a short window, where trend and waves hide each other; the slopes at the minimum are those of the penalty."""
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(np.arange(60.0), 30, replace=False))
    x, y = ccdc.design(t, 3), rng.normal(0, 10, (30, 2))
    start = time.process_time()
    c = ccdc.lasso(x, y, 0.01, 25_000)
    assert time.process_time() - start < 0.2
    slope = (x[:, 1:] - x[:, 1:].mean(0)).T @ (y - x @ c) / len(x)
    held = c[1:] != 0
    assert np.allclose(slope[held], 0.01 * np.sign(c[1:])[held], atol=1e-6) and (np.abs(slope) <= 0.01 + 1e-6).all()


def test_segments_are_fitted_once(spark):
    """reading segments several times does not fit them again."""
    obs = spark.range(400).selectExpr("1L as pixel", "double(id * 8) as t", "double(hash(id) % 7) as q")
    fitted = ccdc.fit_segments(obs, "pixel", "t", ["q"], ccdc.Options(penalty=0.01))
    assert "FlatMapGroupsInPandas" not in fitted._jdf.queryExecution().toString()


def test_outcomes_have_their_allocations(spark):
    """every design that is possible gets the sizes that the plain rule gives."""
    rows = [(1, "EQUAL", 12, 2), (2, "PROPORTIONAL", 31, 4), (3, "OPTIMAL", 50, 3), (4, "OPTIMAL", 5, 4), (5, "EQUAL", None, 2), (6, "OPTIMAL", 50, 3)]
    df = spark.createDataFrame(rows, "id int, strategy string, n int, least int")
    w, p = [0.5, 0.3, 0.2], [0.2, 0.3, 0.4]
    got = {r.id: (r.status, r.sizes) for r in design.outcomes(df, w, p, "n", "strategy", F.col("least")).collect()}
    want = {i: design.outcome(n, None, w, p, 0.95, s, k) for i, s, n, k in rows}
    assert got == {i: (o["status"], o["sizes"]) for i, o in want.items()}


def test_percentiles_without_one_buffer(spark):
    """F16: the same numbers as Spark's exact percentile, which keeps every distinct value in one task."""
    shares = [i / 20 for i in range(21)]
    df = spark.range(0, 20_011, 1, 4).select(F.when(F.col("id") % 50 > 0, F.round(F.rand(5) * 3000) / 7).alias("v"))
    for rows in (df, df.limit(3), df.limit(0)):
        rows = rows.cache()
        out = matching.percentiles(rows, "v", shares, "q")
        assert out.collect() == rows.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()
    assert "percentile" not in out._jdf.queryExecution().toString()


def test_bayesian_alerts_at_even_odds(spark, tmp_path):
    """series of three whose values sum up to 90 end at a probability of one half, where the last bit decides the flag."""
    import duckdb

    rng = np.random.default_rng(2)
    a, b = rng.integers(600, 5900, 4000), rng.integers(600, 2590, 4000)
    rows = [(6 * i + 2 * k, k, i, v / 100) for i, series in enumerate(zip(a.tolist(), b.tolist(), (9000 - a - b).tolist(), strict=True)) for k, v in enumerate(series)]
    events = spark.createDataFrame(rows, "event_id long, k int, user_id long, value double")
    events.select("event_id", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, k)").alias("ts"), "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in change.bayts_alerts(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(ORACLE_SQL["bayts_alerts"]).fetchall())
    assert got == want and sum(p == 0.5 for _, _, p, _ in want) > 1000


def test_gaussians_of_odd_values(spark):
    """null, not-a-number, infinite and huge values give what Spark's own functions give, but for the last bit."""
    df = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,), (1e200,), (0.0,), (1.3,), (40.0,)], "z double")
    for mine, own in df.select(alerts.bell(F.col("z")), F.exp(-F.pow("z", F.lit(2.0)) / 2)).collect():
        assert (mine is None) == (own is None) and (own is None or np.isclose(mine, own, 1e-14, 0, equal_nan=True))


def test_distances_take_no_frame_to_the_end(spark, monkeypatch):
    """such a frame is computed anew for each row of a column, and a group of a single row of the grid costs more than its work."""
    monkeypatch.setattr(tiles, "CELLS", 40, raising=False)
    df = spark.range(2_000).selectExpr("id % 5 - 2 as x", "floor(id / 5) - 9 as y", "id % 97 = 13 as f").where("y % 7 <> 3")
    out = tiles.distance_transform(df, F.col("f"))
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "_strip" in plan
    pixels = df.collect()
    flagged = np.array([(r.x, r.y) for r in pixels if r.f], float)
    want = {(r.x, r.y): np.hypot(flagged[:, 0] - r.x, flagged[:, 1] - r.y).min() for r in pixels}
    got = {(r.x, r.y): r.distance for r in rows}
    assert len(rows) == len(pixels) and got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_cover_goes_over_open_rows_only(spark, monkeypatch):
    """rows that can add nothing any more leave the table that each round reads; picks do not change."""
    sizes, staged = [], selection.staged

    def noted(df, name):
        made = staged(df, name)
        sizes.append(made.count()) if name == "cover" else None
        return made

    monkeypatch.setattr(selection, "staged", noted)
    rows = spark.range(6_000).selectExpr("id % 20 as area", "id as scene", "hash(id) % 40 + 50 as cloud", "explode(sequence(id % 7, id % 7 + 3)) as cell")
    rows = rows.unionByName(spark.sql("select 3L as area, 9000L as scene, 0 as cloud, cast(null as long) as cell"))
    got = sorted(tuple(r) for r in selection.cover_scenes(rows, "area", "scene", "cell", "cloud").collect())
    assert len(sizes) > 2 and all(b < 0.7 * a for a, b in zip(sizes, sizes[1:], strict=False) if a)
    want, held = [], {}
    for r in rows.where("cell is not null").collect():
        held.setdefault(r.area, {}).setdefault(r.scene, {})[r.cell] = 1 - r.cloud / 100
    for area, by_scene in held.items():
        have = dict.fromkeys((c for s in by_scene.values() for c in s), 0.0)
        for rank in range(1, 11):
            gains = {s: round(sum(max(v - have[c], 0.0) for c, v in cells.items()) / len(have), 12) for s, cells in by_scene.items()}
            best = min(gains, key=lambda s: (-gains[s], s))
            if gains[best] <= 0:
                break
            want.append((area, best, rank, round(gains[best], 6)))
            have |= {c: max(v, have[c]) for c, v in by_scene.pop(best).items()}
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)], atol=1e-6)


def test_cover_picks_scenes_that_add_nothing_if_asked(spark):
    """under a negative least gain every scene has its turn."""
    rows = spark.createDataFrame([(1, 1, 7, 10), (1, 2, 7, 20), (1, 3, 7, 10), (2, 4, 8, 50)], "area int, scene int, cell int, cloud int")
    got = sorted(tuple(r) for r in selection.cover_scenes(rows, "area", "scene", "cell", "cloud", least_gain=-1.0).collect())
    assert got == [(1, 1, 1, 0.9), (1, 2, 2, 0.0), (1, 3, 3, 0.0), (2, 4, 1, 0.5)]
