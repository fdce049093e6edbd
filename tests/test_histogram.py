"""Adaptive histograms, what is read off them, and tables that are replaced in one step."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.operators import histogram
from gridloom.sources import swap
from gridloom.sources.tables import shared_folder


def values(seed, n=3000):
    rng = random.Random(seed)
    return [rng.lognormvariate(3, 1) - 5 for _ in range(n)]


def frame(spark, v):
    return spark.createDataFrame([(float(x),) if x is not None else (None,) for x in v], "v double")


def test_buckets(spark):
    v = values(1)
    rows = histogram.adaptive(frame(spark, [*v, None, math.nan, math.inf]), "v", most=64).collect()
    width = rows[0].width
    assert math.log2(width) == int(math.log2(width)) and len(rows) <= 64 and all(r.start % width == 0 for r in rows)
    # half the width would need more buckets
    assert math.floor(max(v) / (width / 2)) - math.floor(min(v) / (width / 2)) + 1 > 64
    want = Counter(math.floor(x / width) * width for x in v)
    assert {r.start: r.n for r in rows} == want
    assert sum(r.n * r.mean for r in rows) == pytest.approx(sum(v))


def test_parts_merge_to_the_whole(spark):
    a, b = values(2), [x * 3 for x in values(3)]
    both = histogram.adaptive(frame(spark, a), "v", most=64).unionByName(histogram.adaptive(frame(spark, b), "v", most=64))
    got = {r.start: (r.width, r.n, r.mean) for r in histogram.merged(both, most=64).collect()}
    width = next(iter(got.values()))[0]
    want = Counter(math.floor(x / width) * width for x in a + b)
    assert {k: n for k, (_, n, _) in got.items()} == want and len(got) <= 64
    assert sum(n * m for _, n, m in got.values()) == pytest.approx(sum(a + b))


def test_quantiles_are_within_a_bucket(spark):
    v = sorted(values(4))
    h = histogram.adaptive(frame(spark, v), "v")
    most = max(r.n for r in h.collect())
    for r in histogram.quantiles(h, [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        rank = sum(x <= r.value for x in v)
        assert abs(rank - r.share * len(v)) <= most


def test_odd_inputs(spark):
    assert histogram.adaptive(frame(spark, []), "v").collect() == []
    (one,) = histogram.adaptive(frame(spark, [7, 7, 7]), "v").collect()
    assert (one.start, one.width, one.n, one.mean) == (7, 0, 3, 7)
    keyed = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, None), (None, 5.0)], "k int, v double")
    assert {r.k for r in histogram.adaptive(keyed, "v", ["k"]).collect()} == {1}
    empty = histogram.adaptive(frame(spark, []), "v")
    assert [r.matched for r in histogram.matched(frame(spark, [1.0]), "v", empty, empty).collect()] == [None]


def test_matching_carries_one_distribution_to_the_other(spark):
    a, b = values(5), [2 * x + 100 for x in values(6)]
    df = frame(spark, [*a, None])
    out = histogram.matched(df, "v", histogram.adaptive(df, "v"), histogram.adaptive(frame(spark, b), "v"))
    moved = sorted(r.matched for r in out.where("matched is not null").collect())
    assert len(moved) == len(a) and out.where("matched is null").count() == 1
    for q in (0.1, 0.5, 0.9):
        assert moved[int(q * len(moved))] == pytest.approx(sorted(b)[int(q * len(b))], rel=0.05)


def test_swaps(spark):
    at = f"{shared_folder(spark)}/swap-test-{random.randrange(10**9)}"
    with pytest.raises(ValueError):
        swap.current(spark, at)
    swap.swap(spark.range(5), at)
    old = swap.current(spark, at)
    swap.swap(old.selectExpr("id + 100 as id"), at)  # made of itself
    assert old.count() == 5  # a reader that has begun
    assert sorted(r.id for r in swap.current(spark, at).collect()) == [100, 101, 102, 103, 104]
    before = swap.version(spark, at)
    with pytest.raises(Exception, match="no such luck"):
        swap.swap(spark.range(3).select(F.raise_error(F.lit("no such luck")).alias("id")), at)
    assert swap.version(spark, at) == before and swap.current(spark, at).count() == 5
    swap.swap(spark.range(2), at)  # again after the failure
    assert swap.current(spark, at).count() == 2
