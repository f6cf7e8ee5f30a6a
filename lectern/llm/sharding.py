"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import Stash


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, by the published algorithm, for all keys at once."""
    state = keys.astype(np.uint64)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    while (moving := ahead < shards).any():
        at[moving] = ahead[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[moving] = ((at[moving] + 1) * step).astype(np.int64)
    return at


def jump_of(key: str | F.Column, shards: int) -> F.Column:
    return F.pandas_udf(lambda k: pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32)), T.IntegerType())(key)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The doc_id itself, a whole number, is the key (ids of other types must be hashed to one first), so a document's shard depends on it and on the number of shards alone;
    with one more shard, rows move only into that. ``slot`` numbers a shard's rows from 0 without gaps, by
    doc_id, then digest and size. Numbering is by ranges of doc_id: rows are sorted within small ranges,
    and a range starts at the sum of the ranges before it, so no task sorts a shard. A range is split
    among repeated ids too. A null doc_id has the key 0 and comes first; a null text has size 1 and the
    digest of no bytes.
    """
    stash = Stash(docs.sparkSession, "shards")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id"), F.lit(0)).cast("long")
    slim = stash.put(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            jump_of(key, shards).alias("shard"),
            jump_of(key, shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "row"]
    ranged = stash.put(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stash.put(sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    return (
        ranged.join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + rank).cast("long").alias("slot"), "grown_shard")
    )
