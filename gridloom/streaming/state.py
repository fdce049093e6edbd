"""Stateful stream operators and a restartable run over what is there now."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, staged as staged


def read_events(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A file stream of events (a file or folder), so many files to a micro-batch, with event time as a timestamp for watermarks."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))


def last_in_window(stream: DataFrame, key: str, width: str, order: Sequence[str], columns: Sequence[str], late: str = "1 day") -> DataFrame:
    """The last item of each key in each tumbling window; empty windows have no row."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(last)
    return rows.select(key, F.col("window.start").alias("start"), "_last.*")


def changes_now(stream: DataFrame, key: str, state: str, order: Sequence[str], name: str = "changes") -> DataFrame:
    """Rows whose state differs from the key's row before, over all present input: a log to which only changes are added.

    A micro-batch compares its rows in a sorted window that spills, and joins each key's first row with the key's last
    state, which lies in a table that every micro-batch writes anew under its own number. A batch that is repeated after a
    failure overwrites its own output. A masked state differs from every state, as its successor does.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        w = Window.partitionBy(key).orderBy(*order)
        rows = batch.withColumns({"_was": F.lag(state).over(w), "_place": F.row_number().over(w)})
        last = batch.groupBy(key).agg(F.max_by(F.struct(F.col(state).alias("s")), F.struct(*order)).alias("_now"))
        if n > 0:
            before = spark.read.schema(f"{key} {dict(batch.dtypes)[key]}, _last {dict(batch.dtypes)[state]}").parquet(f"{base}/last/{n - 1}")
            rows = rows.join(before, key, "left").withColumn("_was", F.when(F.col("_place") == 1, F.col("_last")).otherwise(F.col("_was"))).drop("_last")
            kept = before.join(last, key, "full").select(key, F.when(F.col("_now").isNotNull(), F.col("_now.s")).otherwise(F.col("_last")).alias("_last"))
        else:
            kept = last.select(key, F.col("_now.s").alias("_last"))
        kept.write.mode("overwrite").parquet(f"{base}/last/{n}")
        changed = rows.where(F.col("_was").isNull() | F.col(state).isNull() | (F.col("_was") != F.col(state)))
        changed.drop("_was", "_place").write.mode("overwrite").parquet(f"{base}/out/{n}")

    run = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out/*")


def run_now(stream: DataFrame, keys: Sequence[str], mode: str = "update", name: str = "stream") -> DataFrame:
    """Runs a stream over all its present input and returns the latest row of each key (all rows in append mode).

    Every micro-batch overwrites a folder of its own, so that one that is repeated after a failure counts once.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/{n}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{base}/out/*")
    if mode == "append":
        return rows.drop("_batch")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*").drop("_batch")


def read_staged(rows: DataFrame, files: int = 64) -> DataFrame:
    """A stream of the files of a ``staged`` table."""
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(rows._staged_at)
