"""Scene selection in Spark rounds against simulations in plain Python."""

import random
from collections import defaultdict

from gridloom import plans, registry
from gridloom.operators import selection

_ = plans  # importing it registers the queries
SF = "/root/testdata/sf0.001"


def simulated(rows, target):
    """Areas one after the other, turn by turn."""
    cells, clouds = defaultdict(lambda: defaultdict(set)), {}
    for area, scene, cell, cloud in rows:
        cells[area][scene].add(cell)
        clouds[area, scene] = cloud
    have, open_areas, out, rank = defaultdict(lambda: 1.0), sorted(cells), [], 0
    while open_areas:
        rank += 1
        stay = []
        for area in open_areas:
            gains = {s: (100 - clouds[area, s]) * sum(have[c] >= target for c in cs) for s, cs in cells[area].items()}
            if not gains or max(gains.values()) <= 0:
                continue
            best = min(s for s in gains if gains[s] == max(gains.values()))
            for c in cells[area].pop(best):
                if have[c] >= target:
                    have[c] *= clouds[area, best] / 100
            out.append((area, best, rank))
            stay.append(area)
        open_areas = stay
    return out


def covered(rows, most, least=0, enough=1.0):
    clear = defaultdict(lambda: defaultdict(dict))
    for area, scene, cell, cloud in rows:
        clear[area][scene][cell] = 1 - cloud / 100
    out = []
    for area, scenes in clear.items():
        every = {c for cs in scenes.values() for c in cs}
        have = dict.fromkeys(every, 0.0)
        for rank in range(1, most + 1):
            gains = {s: round(sum(max(v - have[c], 0) for c, v in cs.items()) / len(every), 12) for s, cs in scenes.items()}
            if not gains or max(gains.values()) <= 0 or (rank > max(least, 1) and sum(have.values()) / len(every) >= enough and rank > least):
                break
            best = min(s for s in gains if gains[s] == max(gains.values()))
            for c, v in scenes.pop(best).items():
                have[c] = max(have[c], v)
            out.append((area, best, rank, round(gains[best], 6)))
    return sorted(out)


def scenes(seed, areas=7, each=5, width=30):
    rng = random.Random(seed)
    rows = []
    for a in range(areas):
        for s in range(each):
            cloud = rng.choice([0, 10, 30, 50, 90, 100])
            for c in rng.sample(range(a * 10, a * 10 + width), 12):  # three areas share a cell
                rows.append((a, a * 100 + s, c, cloud))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "area int, scene int, cell int, cloud int")


def test_round_robin_equals_the_simulation(spark):
    for seed, target in ((1, 0.2),):
        rows = scenes(seed)
        found = sorted(tuple(r) for r in selection.round_robin(table(spark, rows + rows[:5]), "area", "scene", "cell", "cloud", target).collect())
        assert found == sorted(simulated(rows, target)) and len({r for _, _, r in found}) > 2


def test_layers_part_neighbours(spark):
    rows = [(1, 0, 5, 0), (2, 0, 5, 0), (3, 0, 5, 0), (3, 0, 6, 0), (4, 0, 6, 0), (9, 0, 7, 0)]
    assert {r.area: r.layer for r in selection.layers(table(spark, rows)).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 9: 0}


def test_round_robin_edges(spark):
    assert selection.round_robin(table(spark, []), "area", "scene", "cell", "cloud", 0.5).collect() == []
    rows = [(1, 1, 1, 100), (1, 2, 1, None), (None, 3, 1, 0), (2, 4, None, 0), (3, 6, 8, 20), (3, 5, 8, 20)]
    assert [tuple(r) for r in selection.round_robin(table(spark, rows), "area", "scene", "cell", "cloud", 0.5).collect()] == [(3, 5, 1)]


def test_round_robin_over_the_whole_table(spark):
    import duckdb

    sql = f"""SELECT DISTINCT s_nationkey, s_suppkey, (s_nationkey // 2) * 1000 + l_partkey % 60, floor(abs(s_acctbal))::BIGINT % 101 FROM '{SF}/lineitem.parquet' JOIN '{SF}/supplier.parquet' ON s_suppkey = l_suppkey"""
    want = sorted(simulated(duckdb.sql(sql).fetchall(), 0.2))
    assert sorted(tuple(r) for r in registry.QUERIES["scene_round_robin"](spark, SF).collect()) == want and want


def test_cover_equals_the_simulation(spark):
    rows = scenes(4)
    of = lambda **x: sorted(tuple(r) for r in selection.cover_scenes(table(spark, rows), "area", "scene", "cell", "cloud", **x).collect())
    assert of(most=3) == covered(rows, 3)
    assert of(most=4, enough=0.5) == covered(rows, 4, 0, 0.5)
    assert of(most=4, least=2, enough=0.1) == covered(rows, 4, 2, 0.1)
    assert selection.cover_scenes(table(spark, []), "area", "scene", "cell", "cloud").collect() == []
