"""Sources of several data sets and verbs on bands. Return flags are data sets, orders are scenes, suppliers are pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsmath, verbs
from ..sources import scenes as S
from ..registry import query, table

KEYS = ["scene", "ts", "pixel"]


def _sets(spark, d) -> dict:
    li = table(spark, d, "lineitem")
    base = li.select(F.col("l_orderkey").alias("scene"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("pixel"), "l_returnflag", F.col("l_quantity").alias("red"), F.col("l_extendedprice").alias("nir"), F.col("l_tax").alias("swir1"), F.col("l_discount").alias("cover"))
    cut = lambda flag, *drop: base.where(F.col("l_returnflag") == flag).drop("l_returnflag", *drop)
    return {"LANDSAT_4": cut("A", "swir1"), "LANDSAT_5": cut("N"), "SENTINEL_2": cut("R", "swir1")}


_SETS = """b AS (SELECT l_orderkey AS scene, l_shipdate AS ts, l_suppkey AS pixel, l_returnflag AS f, l_quantity AS red, l_extendedprice AS nir, l_discount AS cover,
  CASE l_returnflag WHEN 'A' THEN 'LANDSAT_4' WHEN 'N' THEN 'LANDSAT_5' ELSE 'SENTINEL_2' END AS data_set FROM lineitem)"""


@query(f"WITH {_SETS} SELECT scene, ts, pixel, red, nir, data_set FROM b WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-01-01' AND CASE WHEN f = 'R' THEN true ELSE cover <= 0.05 END")
def optical_all_scenes(spark, d):
    names = S.data_sets(["LANDSAT_TM", "SENTINEL_2"])
    return S.all_scenes(_sets(spark, d), names, KEYS, "1995-01-01", "1997-01-01", {"LANDSAT_4": "cover", "LANDSAT_5": "cover"}, 0.05).select("scene", "ts", "pixel", "red", "nir", "data_set")


@query(f"WITH {_SETS} SELECT scene, ts, pixel, red, nir, cover, data_set FROM b WHERE scene IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def optical_selected_scenes(spark, d):
    orders = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("scene"))
    chosen = orders.crossJoin(spark.createDataFrame([("LANDSAT_4",), ("LANDSAT_5",), ("SENTINEL_2",)], "data_set string"))
    return S.selected_scenes(_sets(spark, d), chosen, KEYS)


@query(
    """WITH s AS (SELECT o_orderkey AS scene, ['LANDSAT_TM', 'LANDSAT_8', 'LANDSAT_7_T2', 'SENTINEL_2'][1 + o_orderkey % 4] AS source, o_orderstatus = 'F' AS tier2 FROM orders),
    m(source, base) AS (VALUES ('LANDSAT_TM', 'LANDSAT_4'), ('LANDSAT_TM', 'LANDSAT_5'), ('LANDSAT_8', 'LANDSAT_8'), ('LANDSAT_7_T2', 'LANDSAT_7_T2'), ('SENTINEL_2', 'SENTINEL_2'))
    SELECT scene, base AS data_set FROM s JOIN m USING (source) UNION ALL SELECT scene, base || '_T2' FROM s JOIN m USING (source) WHERE tier2 AND NOT source LIKE '%_T2'"""
)
def data_set_aliases(spark, d):
    """Each order names a source by its key; finished ones want the second tier too."""
    names = F.array(*map(F.lit, ("LANDSAT_TM", "LANDSAT_8", "LANDSAT_7_T2", "SENTINEL_2")))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("scene"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("source"), (F.col("o_orderstatus") == "F").alias("tier2"))
    return S.aliased(o, "source", F.col("tier2")).select("scene", "data_set")


@query("SELECT count(*) > 0 AS has_imagery FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' UNION ALL SELECT count(*) > 0 FROM lineitem WHERE l_shipdate >= TIMESTAMP '2195-01-01'")
def has_imagery(spark, d):
    li = table(spark, d, "lineitem")
    return S.has_imagery(li.where(F.col("l_shipdate") >= "1995-01-01")).unionAll(S.has_imagery(li.where(F.col("l_shipdate") >= "2195-01-01")))


@query(
    """WITH f AS (SELECT event_id, event_type, user_id, CASE WHEN value > 100 THEN value END AS value, props FROM events ORDER BY ts, event_id LIMIT 1), k AS (SELECT unnest(json_keys(to_json(f))) AS name, unnest([x IS NOT NULL FOR x IN [event_id::VARCHAR, event_type, user_id::VARCHAR, value::VARCHAR, props]]) AS has FROM f)
    SELECT name, (row_number() OVER (ORDER BY name) - 1)::INT AS place FROM k WHERE has"""
)
def column_list(spark, d):
    """Properties of the earliest event: a missing value is no property."""
    e = table(spark, d, "events")
    return verbs.first_row_columns(e.select("event_id", "event_type", "user_id", F.when(F.col("value") > 100, F.col("value")).alias("value"), "props", "ts"), ["ts", "event_id"], ["event_id", "event_type", "user_id", "value", "props"])


@query("SELECT o_orderkey AS scene, o_custkey AS owner, l_quantity AS probability FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 10 GROUP BY 1) ON l_orderkey = o_orderkey")
def linked_auxiliary(spark, d):
    aux = table(spark, d, "lineitem").where("l_linenumber = 1 and l_quantity > 10").select(F.col("l_orderkey").alias("scene"), F.col("l_quantity").alias("probability"))
    return S.linked(table(spark, d, "orders").select(F.col("o_orderkey").alias("scene"), F.col("o_custkey").alias("owner")), aux, ["probability"])


@query("SELECT c_custkey AS scene, c_nationkey AS tile, s_acctbal AS x0, s_suppkey AS tile_id FROM customer JOIN (SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) = 1) ON s_nationkey = c_nationkey")
def image_tile_join(spark, d):
    tiles = table(spark, d, "supplier").select("s_nationkey", F.col("s_acctbal").alias("x0"), F.col("s_suppkey").alias("tile_id"))
    return S.first_tile(table(spark, d, "customer").select(F.col("c_custkey").alias("scene"), F.col("c_nationkey").alias("tile")), tiles, "tile", "s_nationkey", ["x0", "tile_id"])


def _radar(spark, d):
    o = table(spark, d, "orders")
    pol = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("VV"))).otherwise(F.array(F.lit("VV"), F.lit("VH")))
    return o.select(F.col("o_orderkey").alias("scene"), F.when(F.col("o_orderstatus") == "P", "EW").otherwise("IW").alias("mode"), pol.alias("polarisations"), F.when(F.col("o_custkey") % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("orbit"), (F.col("o_custkey") % 7).alias("relative_orbit"), F.col("o_totalprice").alias("vv"))


_RADAR = "r AS (SELECT o_orderkey AS scene, o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 AS ok, CASE WHEN o_custkey % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit, o_custkey % 7 AS relative_orbit, o_totalprice AS vv FROM orders)"


@query(f"WITH {_RADAR} SELECT scene, orbit, relative_orbit FROM r WHERE ok AND orbit = 'ASCENDING'")
def radar_scenes(spark, d):
    return S.radar_scenes(_radar(spark, d), ["ASCENDING"]).select("scene", "orbit", "relative_orbit")


@query(f"WITH {_RADAR}, s AS (SELECT orbit, relative_orbit, min(vv) AS low FROM r WHERE relative_orbit < 5 GROUP BY 1, 2) SELECT scene, orbit, relative_orbit, low FROM r LEFT JOIN s USING (orbit, relative_orbit)")
def orbit_stats_lookup(spark, d):
    images = _radar(spark, d).select("scene", "orbit", "relative_orbit", "vv")
    stats = images.where("relative_orbit < 5").groupBy("orbit", "relative_orbit").agg(F.min("vv").alias("low"))
    return S.orbit_lookup(images.drop("vv"), stats, ["orbit", "relative_orbit"], ["low"])


@query(f"WITH {_RADAR}, s AS (SELECT orbit, relative_orbit, 1 + count(*) / 1000.0 AS factor FROM r WHERE relative_orbit < 5 GROUP BY 1, 2) SELECT scene, round(vv * coalesce(factor, 1), 6)::DOUBLE AS vv FROM r LEFT JOIN s USING (orbit, relative_orbit)")
def tile_orbit_correction(spark, d):
    images = _radar(spark, d).select("scene", "orbit", "relative_orbit", "vv")
    factors = images.where("relative_orbit < 5").groupBy("orbit", "relative_orbit").agg((1 + F.count("*") / 1000.0).alias("factor"))
    return S.corrected_if_found(images, factors, ["orbit", "relative_orbit"], "vv", "factor").select("scene", F.round("vv", 6).alias("vv"))


@query(
    """SELECT l_orderkey AS scene, l_suppkey AS pixel, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN l_discount ELSE l_quantity END AS blue, CASE WHEN l_returnflag = 'R' THEN l_tax ELSE l_extendedprice END AS green,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN l_linenumber % 2 ELSE l_linenumber % 3 END::INTEGER AS udm1 FROM lineitem"""
)
def planet_daily_union(spark, d):
    li = table(spark, d, "lineitem")
    df = li.select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("ts"), F.col("l_suppkey").alias("pixel"), F.col("l_returnflag").alias("layout"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_linenumber") % 2).alias("qa12"), (F.col("l_linenumber") % 3).alias("qa16"))
    five = {"l_quantity": "blue", "l_extendedprice": "green"}
    out = S.daily_planet(df, {"A": five, "N": five, "R": {"l_discount": "blue", "l_tax": "green"}}, {"N": "qa12", "R": "qa16"})
    return out.select("scene", "pixel", F.col("ts").alias("line"), "blue", "green", "udm1")


@query(
    """WITH r AS (SELECT o_custkey AS pixel, o_totalprice AS v, o_orderdate >= TIMESTAMP '1996-06-01' AS a, row_number() OVER (PARTITION BY o_custkey, o_orderdate >= TIMESTAMP '1996-06-01' ORDER BY CASE WHEN o_orderdate >= TIMESTAMP '1996-06-01' THEN epoch_us(o_orderdate) ELSE -epoch_us(o_orderdate) END, CASE WHEN o_orderdate >= TIMESTAMP '1996-06-01' THEN o_orderkey ELSE -o_orderkey END) AS k, o_orderkey FROM orders),
    c AS (SELECT *, count_if(a) OVER (PARTITION BY pixel) AS na, count_if(NOT a) OVER (PARTITION BY pixel) AS nb FROM r)
    SELECT pixel, count(*) AS n, round(avg(v), 4) AS mean FROM c WHERE k <= CASE WHEN a THEN 3 + greatest(0, 3 - nb) ELSE 3 + greatest(0, 3 - na) END GROUP BY 1"""
)
def centred_mean(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pixel"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_totalprice").alias("v"))
    mid = F.struct(F.lit("1996-06-01").cast("timestamp").alias("o_orderdate"), F.lit(0).cast("long").alias("o_orderkey"))
    return S.centred(o, "pixel", "at", mid, 3).groupBy("pixel").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


def _bands(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("red_toa"), F.col("l_tax").alias("red_sr"), F.col("l_discount").alias("nir_sr"))


_KEYS = ["l_orderkey", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, l_quantity AS red_toa, l_discount AS nir_sr FROM lineitem")
def exclude_bands(spark, d):
    return verbs.exclude_bands(_bands(spark, d), _KEYS, "^red", "_sr$")


@query("SELECT l_orderkey, l_linenumber, l_tax AS red_sr, -1.0::DOUBLE AS swir FROM lineitem")
def select_or_default(spark, d):
    return verbs.select_or_default(_bands(spark, d), _KEYS, ["red_sr", "swir"], -1.0)


@query("SELECT l_orderkey, l_linenumber, l_tax * 10000 AS red_sr, l_discount * 10000 AS nir_sr, l_quantity AS red_toa FROM lineitem")
def update_bands(spark, d):
    return verbs.update_bands(_bands(spark, d), ["red_sr", "nir_sr", "absent"], lambda c: c * 10000)


@query("SELECT l_orderkey, l_linenumber, l_tax AS red FROM lineitem")
def select_bands(spark, d):
    return verbs.select_bands(_bands(spark, d), _KEYS, ["red_sr", "red_sr"], ["red", "red"])


@query("SELECT l_orderkey, l_linenumber, l_discount AS nir_sr FROM lineitem")
def remove_bands(spark, d):
    return verbs.select_existing(verbs.remove_bands(_bands(spark, d), ["red_toa", "absent"]), _KEYS, ["nir_sr", "absent"])


@query("SELECT l_orderkey, l_linenumber, l_quantity AS red_toa, l_quantity - l_tax AS red_sr, l_discount AS nir_sr, l_quantity * 2 AS twice FROM lineitem")
def add_bands_replace(spark, d):
    return verbs.add_bands(_bands(spark, d), {"red_sr": F.col("red_toa") - F.col("red_sr"), "twice": F.col("red_toa") * 2})


_X = "(l_extendedprice - 30000) / 7"


@query(
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_X} AS x, l_quantity AS q, cast(l_orderkey * 7919 % 4294967296 AS BIGINT) AS u FROM lineitem)
    SELECT l_orderkey, l_linenumber, trunc(x)::BIGINT AS truncated, floor(x + 0.5)::BIGINT AS rounded, x::FLOAT::DOUBLE AS fround, CASE WHEN u = 0 THEN 32 ELSE 32 - length(bin(u)) END::INTEGER AS clz32,
    ((((u * 2654435761::HUGEINT) % 4294967296) + 2147483648) % 4294967296 - 2147483648)::BIGINT AS imul, round(sqrt(x * x + q * q), 6) AS hypot, round(x - q * trunc(x / q), 6) AS remainder, sign(x)::DOUBLE AS sign, round(cbrt(x), 6) AS cbrt FROM t"""
)
def js_math(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_extendedprice") - 30000) / 7).alias("x"), F.col("l_quantity").alias("q"), (F.col("l_orderkey") * 7919 % (1 << 32)).alias("u"))
    x, q, u = F.col("x"), F.col("q"), F.col("u")
    return li.select(
        "l_orderkey", "l_linenumber", jsmath.trunc(x).alias("truncated"), jsmath.half_up(x).alias("rounded"), jsmath.fround(x).alias("fround"), jsmath.clz32(u).alias("clz32"),
        jsmath.imul(u, F.lit(2654435761)).alias("imul"), F.round(jsmath.hypot(x, q), 6).alias("hypot"), F.round(jsmath.remainder(x, q), 6).alias("remainder"), F.signum(x).alias("sign"), F.round(F.cbrt(x), 6).alias("cbrt"),
    )
