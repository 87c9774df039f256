"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone; when shards are appended, only the rows that go into
them move. Rows are numbered within their shard without a sort: each input task counts its own rows per shard, and the
running sums of these counts over tasks give each task's first slot.

Defined cases: a null key hashes as key 0; a null text has no bytes (size 1, crc32 0); texts of any length only
count and are never moved; rows with one key share a shard and, repeated rows too, get slots of their own in no stated order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.llm.common import checkpointed, text_or_empty

SHARDS = 8


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shards of 64-bit keys, all keys in step."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.float64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = ahead[moving].astype(np.int64)
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = np.floor((shard[moving] + 1) * (float(1 << 31) / draw))
        moving = moving[ahead[moving] < shards]
    return shard


def assign(docs: DataFrame, shards: int = SHARDS, grown: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with `grown` shards, one more by default)."""
    more = shards + 1 if grown is None else grown
    text = text_or_empty(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            keys = np.asarray(batch.column(0).fill_null(0), np.int64)
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
            place += seen[shard]
            seen += counts
            columns = [*batch.columns, pa.array(shard, pa.int32()), pa.array(jump_hash(keys, more), pa.int32()), pa.array(np.full(len(keys), task), pa.int64()), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "text_crc32", "shard", "grown_shard", "task", "place"])

    schema = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, task long, place long"
    # kept once, so that counts and rows come from the same run of each task
    placed = checkpointed(rows.mapInArrow(number, schema))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return placed.join(firsts, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("place")).alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All of docs as Parquet, in one folder per shard; a shard may have many files."""

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.fillna(0).to_numpy(np.int64), shards).astype(np.int32))

    docs.withColumn("shard", shard_of(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))).write.partitionBy("shard").parquet(path)
