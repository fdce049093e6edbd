"""Assets, catalog ingest and exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "orc": "orc"}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, a lost executor costs no recomputation, and a stream can read
    it as well."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def asset(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | None = None, **options) -> DataFrame:
    """A table of a known kind; other kinds are refused."""
    if kind not in FORMATS:
        raise ValueError(f"unknown asset kind {kind!r}")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(FORMATS[kind]).load(path)


def ingest_csv(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str], since: Column | None = None) -> DataFrame:
    """Rows of (gzipped) CSV files with a header, from a cut-off on; the first of each key in the order given stays."""
    rows = asset(spark, path, "csv", schema, header="true")
    rows = rows if since is None else rows.where(since)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def high_water(df: DataFrame, dataset: str, ts: str) -> DataFrame:
    """Latest timestamp of each dataset: where its next increment starts."""
    return df.groupBy(dataset).agg(F.max(ts).alias("high_water"))


def increment(df: DataFrame, marks: DataFrame, dataset: str, ts: str, delay: str = "24 hours", now: str | None = None) -> DataFrame:
    """Rows after their dataset's mark, but not within the publication delay."""
    rows = df.join(marks, dataset, "left").where(F.col("high_water").isNull() | (F.col(ts) > F.col("high_water"))).drop("high_water")
    return rows if now is None else rows.where(F.col(ts) <= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {delay}"))


def export_tiles(df: DataFrame, path: str, tile: str, resume: bool = False) -> None:
    """A folder for each tile; with ``resume``, tiles that are there already are left alone."""
    spark = df.sparkSession
    if resume:
        try:
            done = spark.read.parquet(path).select(F.col(tile).cast("string").alias("_tile")).distinct()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            df = df.join(done, df[tile].cast("string") == done["_tile"], "left_anti")
        df.write.partitionBy(tile).mode("append").parquet(path)
    else:
        df.write.partitionBy(tile).mode("overwrite").parquet(path)


def scalar_properties(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that flat formats can hold them."""
    return df.select(*(F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in df.dtypes))


def export_csv(df: DataFrame, path: str) -> None:
    scalar_properties(df).write.mode("overwrite").option("header", "true").csv(path)


def geojson_features(df: DataFrame, x: str, y: str) -> DataFrame:
    """One GeoJSON feature in text for each row, as line-delimited files hold them."""
    rest = [c for c in df.columns if c not in (x, y)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def stack_series(df: DataFrame, keys: Sequence[str], date: str, value: str, dates: Sequence[str]) -> DataFrame:
    """A column for each of the given dates; the median of what falls on the same date."""
    return df.groupBy(*keys).pivot(date, list(dates)).agg(F.median(value))
