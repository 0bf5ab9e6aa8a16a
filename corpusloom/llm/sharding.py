"""Sharding by jump consistent hashing: a row's shard follows from its key and the number of shards alone, without a ring table.

Going from n to n + 1 shards moves only the rows that go to the new shard, about 1 in n + 1. The key of a row is its doc_id; a row
without one is keyed by its text, so that such rows spread as well. Slots number the rows of a shard without gaps: each input
partition counts its own rows, and the counts of the partitions before it are added, so that no shard meets in one task.

Defined cases: a null text has 8 bytes and the CRC-32 of an empty one; repeated rows get a slot each; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .base import joined_small, stored, text_of

ROW_BYTES = 8


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of uint64 keys, for all keys at once."""
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    at = np.zeros(len(key), np.int64)
    while len(live):
        out[live] = at
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        at = ((at + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = at < shards
        live, key, at = live[on], key[on], at[on]
    return out


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A well mixed 64-bit key that depends on doc_id alone where there is one."""
    return F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id).cast("long"))).otherwise(F.xxhash64(text_of(text)))


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more) of each row."""

    def place(batches):
        counts, part = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            keys = np.asarray(batch.column("key")).view(np.uint64)
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=shards)
            rank = np.empty(len(shard), np.int64)
            rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n, n)
            columns = {"shard": shard.astype(np.int32), "local": rank + counts[shard], "grown_shard": jump_hash(keys, shards + 1).astype(np.int32), "part": np.full(len(shard), part, np.int32)}
            counts += n
            kept = ["doc_id", "size", "text_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, columns.values())], [*kept, *columns])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text_of()) + ROW_BYTES).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"), key_of().alias("key"))
    placed = stored(rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, local long, grown_shard int, part int"), "shards")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "shard-counts")
    out = joined_small(placed, counts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("local")).alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Writes whole rows under path, in a folder shard=k for each shard; a column shard of the rows gives way to that."""

    def number(batches):
        for batch in batches:
            keys = np.asarray(batch.column("key")).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(jump_hash(keys, shards).astype(np.int32))], ["doc", "shard"])

    kept = [c for c in docs.columns if c.lower() != "shard"]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), key_of().alias("key"))
    schema = StructType([keyed.schema["doc"], StructField("shard", IntegerType())])
    keyed.mapInArrow(number, schema).select("doc.*", "shard").write.partitionBy("shard").parquet(path)
