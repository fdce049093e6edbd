"""Ingest and export shapes of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as T
from ..registry import query, table


@query("SELECT event_type, max(ts) AS high_water FROM events GROUP BY 1")
def ingest_high_water(spark, d):
    return T.high_water(table(spark, d, "events"), "event_type", "ts")


@query(
    """WITH m AS (SELECT event_type, max(ts) AS h FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'view' GROUP BY 1)
    SELECT event_id FROM events LEFT JOIN m USING (event_type) WHERE (h IS NULL OR ts > h) AND ts <= TIMESTAMP '2024-01-25' - INTERVAL 24 HOURS"""
)
def ingest_increment(spark, d):
    e = table(spark, d, "events")
    marks = T.high_water(e.where("ts < timestamp_ntz'2024-01-15' and event_type <> 'view'"), "event_type", "ts")
    return T.increment(e, marks, "event_type", "ts", now="2024-01-25").select("event_id")


@query("SELECT n_nationkey, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',' || n_regionkey || ']},\"properties\":{\"n_name\":\"' || n_name || '\"}}' AS value FROM nation")
def geojson_export(spark, d):
    n = table(spark, d, "nation")
    out = T.geojson_features(n, "n_nationkey", "n_regionkey")
    return out.select(F.get_json_object("value", "$.geometry.coordinates[0]").cast("int").alias("n_nationkey"), "value")


@query("SELECT s_name, 'L' || lpad(s_suppkey::VARCHAR, 6, '0') || '_' || regexp_extract(s_name, '#0*([0-9]+)$', 1) AS id, least(s_suppkey % 101 + 22, 100)::BIGINT AS cloud FROM supplier")
def scene_row_mapping(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("L"), F.lpad(k.cast("string"), 6, "0"), F.lit("_"), F.regexp_extract("s_name", "#0*([0-9]+)$", 1))
    return table(spark, d, "supplier").select("s_name", name.alias("id"), F.least(k % 101 + 22, F.lit(100)).alias("cloud"))


@query("SELECT o_custkey AS pixel, round(median(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996),3) AS \"1996\", round(median(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997),3) AS \"1997\" FROM orders GROUP BY 1")
def stack_time_series(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("pixel"), F.year("o_orderdate").cast("string").alias("y"), "o_totalprice")
    out = T.stack_series(o, ["pixel"], "y", "o_totalprice", ["1996", "1997"])
    return out.select("pixel", *(F.round(F.col(f"`{c}`"), 3).alias(c) for c in ("1996", "1997")))


@query("SELECT s_suppkey, '{\"k\":' || s_nationkey || '}' AS props FROM supplier")
def format_properties(spark, d):
    s = table(spark, d, "supplier")
    return T.scalar_properties(s.select("s_suppkey", F.struct(F.col("s_nationkey").alias("k")).alias("props")))
