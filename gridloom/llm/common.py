"""Shared folders, written intermediates and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to this many rows of a few numbers each (tens of MB); beyond it a shuffle join runs.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and a lost executor costs no recomputation.

    Readers see exact sizes, so that joins on it are planned by them. The files go by ``released``, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _place(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def released(*tables: DataFrame) -> None:
    """Deletes the files of written tables, once everything made from them is written as well."""
    for df in tables:
        files, at = _place(df.sparkSession, df._written_to)
        files.delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the table that they were made for is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if a count proves ``df`` (a written table) to be small, else ``df`` for a shuffle join."""
    return F.broadcast(df) if df.count() <= limit else df


def is_column(name: str, *names: str) -> bool:
    """Whether a column's name is one of ``names``, as Spark compares them: whatever their case."""
    return name.lower() in {n.lower() for n in names}
