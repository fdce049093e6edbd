"""Exact token-length histogram: totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import default_path, encoder

#: Lengths to a block of the two-level running sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, text_col: str = "text", extra: int = 1, path: str | None = None) -> DataFrame:
    """``length`` of every row's whole text in tokens, with ``extra`` end tokens; null counts as empty."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode.count(t.as_py()) + extra for t in b.column(0)], pa.int64())], names=["length"])

    return docs.select(text_col).mapInArrow(run, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``(length, n_docs)``: counted on each task before the shuffle; it has a row for each distinct length only."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For every context limit at which something changes (each occurring length), exact sums over all documents.

    A row: ``context_limit, n_docs`` (of just that length), ``n_fit`` and ``tokens_fit`` (documents no longer than it,
    and their tokens), ``n_over``, ``kept_tokens`` (total if every document is cut to the limit), ``lost_tokens``,
    ``quantile`` (share of documents that fit), ``total_docs, total_tokens``. Between two rows, kept_tokens is linear
    with slope n_over. Sums run inside blocks of lengths and over blocks, so no task holds the histogram of a long tail
    of lengths; the table of blocks has a row for each ``BLOCK`` lengths. An empty histogram gives an empty result.
    """
    cells = written(histogram, "lengths").withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("t", F.col("length") * F.col("n_docs"))
    up = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("t").alias("bt"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("bn").over(up), F.lit(0)).alias("n0"), F.coalesce(F.sum("bt").over(up), F.lit(0)).alias("t0"),
        F.sum("bn").over(whole).alias("total_docs"), F.sum("bt").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumns({"n1": F.sum("n_docs").over(inside), "t1": F.sum("t").over(inside)}).join(blocks, "block")
    fit = summed.select(
        F.col("length").alias("context_limit"), "n_docs", (F.col("n0") + F.col("n1")).alias("n_fit"), (F.col("t0") + F.col("t1")).alias("tokens_fit"), "total_docs", "total_tokens"
    )
    fit = fit.withColumn("n_over", F.col("total_docs") - F.col("n_fit"))
    fit = fit.withColumn("kept_tokens", F.col("tokens_fit") + F.col("n_over") * F.col("context_limit"))
    return fit.select(
        "context_limit", "n_docs", "n_fit", "tokens_fit", "n_over", "kept_tokens", (F.col("total_tokens") - F.col("kept_tokens")).alias("lost_tokens"),
        (F.col("n_fit") / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens",
    )


def quantile_length(table: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least ``q`` of all documents do not exceed (one row; null if there is none)."""
    return table.where(F.col("n_fit") >= F.ceil(F.lit(q) * F.col("total_docs"))).agg(F.min("context_limit").alias("length"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """Total tokens if each document is cut to ``limit`` (one row; null for an empty table)."""
    all_docs = F.max("total_docs")
    below = F.when(F.col("context_limit") <= limit, F.col("context_limit"))
    at = F.max_by(F.struct("tokens_fit", "n_over"), below)
    return table.agg(F.coalesce(at["tokens_fit"] + at["n_over"] * limit, all_docs * limit).alias("kept_tokens"))
