"""Sharding by a permutation-filled lookup table: even load, little movement when shards come or go."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_column

TABLE_SIZE = 65_537
SHARDS = 64
#: Largest table that is broadcast (some tens of MB).
MOST_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> np.ndarray:
    """``table[slot]`` is the index in ``shards``: shards take turns claiming the next free slot they prefer.

    A shard prefers ``offset, offset + skip, offset + 2 skip ...`` modulo the prime table size, both hashed from its
    name, so its preferences visit every slot. The order of ``shards`` has no effect but for the indices.
    """
    if table_size > MOST_SLOTS or not is_prime(table_size):
        raise ValueError(f"the table size must be prime, {MOST_SLOTS} at most")
    if not shards or len(set(shards)) != len(shards) or len(shards) > table_size:
        raise ValueError("shards must be distinct, one at least, and fit the table")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: xxhash.xxh64_intdigest(shards[i], 0) % table_size for i in turns}
    skip = {i: xxhash.xxh64_intdigest(shards[i], 1) % (table_size - 1) + 1 if table_size > 2 else 1 for i in turns}
    table, left = np.full(table_size, -1, np.int32), table_size
    while left:
        for i in turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % table_size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: Sequence[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """``(slot, shard)``: ``table_size`` rows, whatever the data's size."""
    table = lookup_table(shards, table_size)
    return spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot int, shard string")


def slot_of(key: F.Column, table_size: int = TABLE_SIZE) -> F.Column:
    """Slot of a key: XXH64 (seed 42) of its text, null as the empty text, modulo the table size."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(table_size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str] | None = None, table_size: int = TABLE_SIZE, spread_by: str | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of each row, in constant time by a broadcast of the table; nothing is shuffled.

    Equal keys share a shard. ``spread_by`` names a column that is hashed with the key, for keys too frequent for one
    shard. Null keys count as empty text; repeated rows keep their multiplicity; columns named slot or
    shard (in any case) are replaced; an empty table gives an empty result. The table is broadcast: MOST_SLOTS bounds it.
    """
    shards = shards or [f"shard-{i:05d}" for i in range(SHARDS)]
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if spread_by:
        k = F.concat_ws("\x1f", k, F.coalesce(F.col(spread_by).cast("string"), F.lit("")))
    kept = [c for c in df.columns if not is_column(c, "slot", "shard")]
    rows = df.select(*kept, slot_of(k, table_size).alias("slot"))
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, table_size)), "slot").select(*kept, "slot", "shard")
