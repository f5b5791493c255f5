"""Stable shards by jump consistent hashing.

The shard of a row depends on its key and the number of shards alone; no ring or table is kept. When shards are
appended, the rows that move go to the new shards only, about one in ``shards + 1`` for one more shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Fixed values of jump consistent hashing: the multiplier of its generator and the range of its draws.
MULTIPLIER, DRAWS = 2862933555777941757, float(1 << 31)
#: Rows that share a block of slots; the number of blocks grows with the table.
BLOCK_ROWS = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    state, shard, ahead = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    moving = np.arange(len(keys))
    while len(moving):
        shard[moving] = ahead[moving]
        state[moving] = state[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = DRAWS / ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = ((shard[moving] + 1) * step).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column of type long; null counts as 0."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return F.pandas_udf(of, IntegerType())(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """Shard and gapless slot of every row of ``docs``: one output row per input row.

    Columns: ``doc_id``; ``size`` (UTF-8 bytes of the text, none for null, plus ``overhead``); ``text_crc32``
    (unsigned; null text counts as empty); ``law`` (always ``key``); ``shard``; ``slot`` (from 0 in each shard, in
    the order of a hash of the id); ``grown_shard`` (with one more shard). A null id is sharded as 0. Rows that
    repeat an id share its shard and get a slot each. An empty table gives no rows. Only the two named columns are
    read, so others cannot clash.

    A shard's rows are never sorted in one task: they are dealt into blocks by a hash of the id, numbered within
    the block, and moved up by the number of rows in the blocks before.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col)
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(doc_id, shards).alias("shard"),
        shard_of(doc_id, shards + 1).alias("grown_shard"),
    )
    blocks = max(1, -(-docs.count() // (BLOCK_ROWS * shards)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moved = rows.groupBy("shard", "block").count()
    moved = moved.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "block").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(order) - 1)
    return numbered.join(moved, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("place")).alias("slot"), "grown_shard"
    )
