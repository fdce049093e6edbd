"""Band math: indexes, tasseled cap, scores, combinations, bits, mask algebra. Embedding slots play reflectances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, hashing, indexes, masks
from ..operators import fitting
from ..registry import query, table

_B = "SELECT vec_id, " + ", ".join(f"0.3 + 0.2 * embedding[{i + 1}]::DOUBLE AS {b}" for i, b in enumerate((*indexes.BANDS, "thermal"))) + " FROM embeddings"


def pixels(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *((0.3 + 0.2 * F.col("embedding")[i].cast("double")).alias(b) for i, b in enumerate((*indexes.BANDS, "thermal"))))


_COLUMNS = {b: F.col for b in (*indexes.BANDS, "thermal")}
_N = "({0}-{1})/nullif({0}+{1},0)"
_SQL = {
    "ndvi": _N.format("nir", "red"), "ndmi": _N.format("nir", "swir1"), "ndwi": _N.format("green", "nir"), "mndwi": _N.format("green", "swir1"),
    "evi": "2.5*(nir-red)/nullif(nir+6*red-7.5*blue+1,0)", "evi2": "2.5*(nir-red)/nullif(nir+2.4*red+1,0)", "savi": "1.5*(nir-red)/nullif(nir+red+0.5,0)", "nbr": _N.format("nir", "swir2"),
    "mvi": "least(greatest(0.1*(nir-green)/nullif(abs(swir1-green),0),-1),1)", "ui": _N.format("swir2", "nir"), "ndbi": _N.format("swir1", "nir"), "nbi": "red*swir1/nullif(nir,0)",
    "bui": _N.format("red", "swir1") + "+" + _N.format("swir2", "swir1"), "kndvi": "(1-exp(-pow(nir-red,2)/0.08))/(1+exp(-pow(nir-red,2)/0.08))",
}
_IBI = f"({_SQL['ndbi']} - ({_SQL['savi']} + {_SQL['mndwi']})/2) / nullif({_SQL['ndbi']} + ({_SQL['savi']} + {_SQL['mndwi']})/2, 0)"


@query("SELECT vec_id, " + ", ".join(f"round({v},6) AS {k}" for k, v in (_SQL | {"ibi": _IBI}).items()) + f" FROM ({_B})")
def spectral_indexes(spark, d):
    b = {n: F.col(n) for n in _COLUMNS}
    return pixels(spark, d).select("vec_id", *(F.round(indexes.INDEXES[k](b), 6).alias(k) for k in (*_SQL, "ibi")))


@query(f"SELECT vec_id, CASE WHEN swir1 + thermal > 0 THEN round((swir1-nir)/(10*sqrt(CASE WHEN swir1 + thermal > 0 THEN swir1+thermal END)),6) END AS ebbi FROM ({_B})")
def index_ebbi(spark, d):
    b = {n: F.col(n) for n in _COLUMNS}
    return pixels(spark, d).select("vec_id", F.when(F.col("swir1") + F.col("thermal") > 0, F.round(indexes.INDEXES["ebbi"](b), 6)).alias("ebbi"))


@query("SELECT vec_id, " + ", ".join("round(" + "+".join(f"({c}*{b})" for c, b in zip(row, indexes.BANDS, strict=True)) + f",8) AS {name}" for name, row in indexes.TASSELED_CAP.items()) + f" FROM ({_B})")
def tasseled_cap(spark, d):
    b = {n: F.col(n) for n in indexes.BANDS}
    return pixels(spark, d).select("vec_id", *(F.round(v, 8).alias(k) for k, v in indexes.tasseled_cap(b).items()))


@query(f"SELECT vec_id, round(blue/nullif(red,0),6) AS blue_red_ratio, round((blue-red)/nullif(blue+red,0),6) AS blue_red_normalized_difference, round(blue-red,8) AS blue_red_difference, round(atan2(blue,red)/pi(),6) AS blue_red_distance, round(sqrt(blue*blue+red*red),6) AS blue_red_angle FROM ({_B})")
def pairwise_bands(spark, d):
    return pixels(spark, d).select("vec_id", *(F.round(v, 8 if k.endswith("_difference") and "normalized" not in k else 6).alias(k) for k, v in indexes.pairwise(["blue", "red"]).items()))


_SC = "least(greatest(({0}-({1}))/(({2})-({1})),0),1)"
_ND = _SQL["mndwi"]
_SNOW = "(" + "*".join(_SC.format(*x) for x in ((_ND, 0.2, 0.42), ("nir", 0.15, 0.35), ("blue/nullif(red,0)", 0.18, 0.22), (_ND, 0.85, 0.95))) + " > 0.12)"


@query(
    f"""SELECT vec_id, round(sqrt((green*green+red*red+nir*nir)/3),6) AS shadow, coalesce({_SNOW}, false) AS snow, coalesce(NOT {_SNOW} AND (blue/nullif(swir1,0) > 4 OR {_SQL['ndwi']} > 0.15), false) AS water,
    coalesce(blue/nullif(swir1,0) < 0.55 OR nir/nullif(swir1,0) < 0.9, false) AS soil,
    round(least({_SC.format('blue', 0.1, 0.5)}, {_SC.format('red+green+blue', 0.2, 0.8)}, {_SC.format('nir+swir1+swir2', 0.3, 0.8)}, {_SC.format(_ND, 0.8, 0.6)}),6) AS cloud FROM ({_B})"""
)
def quality_scores(spark, d):
    b = {n: F.col(n) for n in indexes.BANDS}
    no = lambda c: F.coalesce(c, F.lit(False))
    return pixels(spark, d).select("vec_id", F.round(indexes.shadow_score(b), 6).alias("shadow"), no(indexes.snow(b)).alias("snow"), no(indexes.water(b)).alias("water"), no(indexes.soil(b)).alias("soil"), F.round(indexes.cloud_score(b), 6).alias("cloud"))


@query(f"SELECT vec_id, round((nir-red)*2,6) AS a, round(((nir-red)*2)*((nir-red)*2)+blue,6) AS b, CASE WHEN nir > red THEN 1 ELSE 0 END AS c FROM ({_B})")
def band_math(spark, d):
    """Ordered calculations, each of which may use the ones before, then the outputs."""
    calculations = [("x", "(nir - red) * 2"), ("y", "x * x + blue"), ("z", "case when nir > red then 1 else 0 end")]
    df = pixels(spark, d)
    for name, formula in calculations:
        df = df.withColumn(name, F.expr(formula))
    return df.select("vec_id", F.round("x", 6).alias("a"), F.round("y", 6).alias("b"), F.col("z").alias("c"))


@query(f"SELECT vec_id, round(least(blue,green,red),8) AS low, round(greatest(blue,green,red),8) AS high, round((blue+green+red)/3,8) AS mean FROM ({_B})")
def band_reducers(spark, d):
    """Reducers across bands skip masked ones."""
    names = ["blue", "green", "red"]
    return pixels(spark, d).select("vec_id", F.round(F.least(*names), 8).alias("low"), F.round(F.greatest(*names), 8).alias("high"), F.round(masks.mean_of(*map(F.col, names)), 8).alias("mean"))


@query(
    """SELECT o_orderkey, (o_orderkey & 1) = 1 AS fill, ((o_orderkey >> 3) & 1) = 1 AS cloud, ((o_orderkey >> 8) & 3) = 3 AS moderate, ((o_orderkey >> 8) & 3) >= 2 AS aggressive, ((o_orderkey - 7) % 2 + 2) % 2 AS parity,
    (o_orderkey << 32) + o_custkey AS key FROM orders"""
)
def qa_bit_flags(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", (bits.field(k, 0) == 1).alias("fill"), (bits.field(k, 3) == 1).alias("cloud"), (bits.field(k, 8, 9) == 3).alias("moderate"), (bits.field(k, 8, 9) >= 2).alias("aggressive"),
        bits.parity(k - 7).alias("parity"), bits.cell_key(k, F.col("o_custkey")).alias("key"),
    )


_M = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 7 < 3 END AS b, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS x FROM events"


@query(f"SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a AND b END AS both, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a OR b END AS either, CASE WHEN x IS NULL THEN NULL WHEN b THEN -1.0 ELSE x END AS x FROM ({_M})")
def mask_algebra(spark, d):
    i = F.col("event_id")
    df = table(spark, d, "events").select("event_id", F.when(i % 3 != 0, i % 2 == 0).alias("a"), F.when(i % 5 != 0, i % 7 < 3).alias("b"), F.when(i % 4 != 0, F.col("value")).alias("x"))
    return df.select("event_id", masks.both(F.col("a"), F.col("b")).alias("both"), masks.either(F.col("a"), F.col("b")).alias("either"), masks.where(F.col("x"), F.col("b"), -1.0).alias("x"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT c_custkey, round(('0x'||substr(md5('7:'||c_custkey),1,8))::BIGINT/4294967296.0,9)::DOUBLE AS u FROM customer")
def hashed_uniform(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(hashing.uniform("7", F.col("c_custkey")), 9).alias("u"))


@query("SELECT l_suppkey AS pixel, round(10*log10(avg(l_extendedprice)),6) AS db, round(avg(l_quantity)/cos(30*pi()/180),6) AS gamma0 FROM lineitem GROUP BY 1")
def radar_decibels(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pixel"))
    return li.agg(F.round(10 * F.log10(F.avg("l_extendedprice")), 6).alias("db"), F.round(F.avg("l_quantity") / F.cos(F.radians(F.lit(30.0))), 6).alias("gamma0"))


@query(
    """WITH s AS (SELECT l_suppkey AS pixel, min(l_quantity) AS vv_min, max(l_quantity) AS vv_max, median(l_quantity) AS vv_med, stddev_pop(l_quantity) AS sv, avg(pow(10, l_quantity/10)) AS nv, median(l_tax) AS vh_med, stddev_pop(l_tax) AS sh, avg(pow(10, l_tax/10)) AS nh FROM lineitem GROUP BY 1),
    c AS (SELECT *, 10*log10(sv/nv) AS cv, 10*log10(sh/nh) AS ch FROM s) SELECT pixel, vv_min, vv_max, round(vv_med-vh_med,6) AS ratio, round(cv,5) AS vv_cv, round(ch,5) AS vh_cv, round((cv-ch)/nullif(cv+ch,0),6) AS ndcv FROM c"""
)
def radar_time_scan(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pixel"))
    natural = lambda c: F.avg(F.pow(F.lit(10.0), F.col(c) / 10))
    cv = lambda c: 10 * F.log10(F.stddev_pop(c) / natural(c))
    s = li.agg(F.min("l_quantity").alias("vv_min"), F.max("l_quantity").alias("vv_max"), (F.median("l_quantity") - F.median("l_tax")).alias("ratio"), cv("l_quantity").alias("v"), cv("l_tax").alias("h"))
    return s.select("pixel", "vv_min", "vv_max", F.round("ratio", 6).alias("ratio"), F.round("v", 5).alias("vv_cv"), F.round("h", 5).alias("vh_cv"), F.round(masks.ratio(F.col("v") - F.col("h"), F.col("v") + F.col("h")), 6).alias("ndcv"))


@query()
def index_ndfi(spark, d):
    return fitting.degradation_index(pixels(spark, d)).select("vec_id", "ndfi")
