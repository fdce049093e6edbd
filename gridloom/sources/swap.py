"""Tables that are replaced in one step: readers see the version before or the one after, never a mix or nothing.

A version is a folder of its own; a small file names the present one and is renamed over its predecessor. A writer that fails leaves
the file as it was, and what it has written is removed by the next swap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CURRENT = "_current"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    at = place(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def version(spark: SparkSession, table: str) -> str | None:
    """Name of the table's present version, None if it has none yet."""
    files, place = _files(spark, table)
    at = place(f"{table}/{CURRENT}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The table's present version; a frame that is read again later still reads this one."""
    name = version(spark, table)
    if name is None:
        raise ValueError(f"{table} has no version yet")
    return spark.read.parquet(f"{table}/{name}")


def swap(df: DataFrame, table: str, keep: int = 2) -> str:
    """Writes ``df`` beside the table's versions, then makes it the present one; returns its name.

    The last ``keep`` versions stay for readers that have begun; older ones, and what failed writers have left, go. ``df`` may read
    the table itself. Of two writers at once the later rename wins, whole.
    """
    spark = df.sparkSession
    files, place = _files(spark, table)
    before = version(spark, table)
    number = int(before.split("-")[1]) + 1 if before else 1
    name = f"v-{number:08d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{name}")
    note = f"{table}/.{CURRENT}-{uuid.uuid4().hex}"
    out = files.create(place(note), True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place(table).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context.rename(place(note), place(f"{table}/{CURRENT}"), how)
    there = sorted(s.getPath().getName() for s in files.listStatus(place(table)) if s.getPath().getName().startswith("v-"))
    for old in [v for v in there if int(v.split("-")[1]) <= number - keep or (int(v.split("-")[1]) == number and v != name)]:
        files.delete(place(f"{table}/{old}"), True)
    return name
