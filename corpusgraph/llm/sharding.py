"""Sharding by jump consistent hashing.

A stable key and the shard count decide the shard; there is no ring table.
Going from n to n + 1 shards moves a row only into shard n, and about one row
in n + 1 moves at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are numbered inside this many buckets of a shard first.
BUCKETS = 1024
_RUN = 1 << 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of unsigned 64-bit keys, for all keys at once."""
    key = keys.astype(np.uint64)
    home = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    at = np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            home[live] = at[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
            at[live] = ((home[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            live = live[at[live] < shards]
    return home


def shard_of(key: Column, shards: int) -> Column:
    """The shard of ``key`` (a long column, null not allowed) among ``shards``."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return of(key)


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """A row for each row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (a null text: none) plus 1.  slot counts a
    shard's rows from 0 without gaps.  A null key has a shard of its own
    choosing like any other value.  Equal keys share a shard; equal rows get
    different slots.  An empty table gives no rows, and further columns are
    not looked at.

    Equal rows are counted before they are shuffled, and slots are numbered
    in buckets by hash whose sizes are then summed up, so no shard and no
    repeated key passes through one task.
    """
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.col(text).isNull().alias("_none"),
    )
    counted = rows.groupBy("_key", "size", "text_crc32", "_none").agg(F.count("*").alias("_n"))
    stable = F.xxhash64(F.col("_key"), F.lit("shard"))
    placed = counted.select(
        "*",
        shard_of(stable, shards).alias("shard"),
        shard_of(stable, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("_key", "size", "text_crc32"), F.lit(buckets)).alias("_bucket"),
    )
    sums = placed.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("shard", "_bucket").orderBy("_key", "size", "text_crc32", "_none").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_first", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    # at most shards * buckets rows
    slotted = numbered.join(F.broadcast(sums), ["shard", "_bucket"]).withColumn("_from", F.col("_base") + F.col("_first"))
    runs = slotted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _RUN))))
    slot = F.explode(F.sequence(F.col("_from") + F.col("_run") * _RUN, F.col("_from") + F.least(F.col("_n"), (F.col("_run") + 1) * _RUN) - 1))
    return runs.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
