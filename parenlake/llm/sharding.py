"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from its key and the number of shards alone; no table of
ring points exists. Going from n to n + 1 shards moves about 1/(n+1) of the
keys, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parenlake.llm.common import arrow_map, positions, stage, text_of

#: Fixed value: multiplier of the published generator.
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys at once."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state = keys.astype(np.uint64, copy=True)
    at, ahead = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    open_ = np.arange(len(keys))
    while len(open_):
        at[open_] = ahead[open_]
        state[open_] = state[open_] * _STEP + np.uint64(1)
        draw = (state[open_] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[open_] = np.minimum((at[open_] + 1) * (2147483648.0 / draw), shards).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return at.astype(np.int32)


def assign(df: DataFrame, key: str, shards: int, out: str = "shard", grown: str | None = None) -> DataFrame:
    """Add ``out``: the shard (0 to ``shards`` - 1) of column ``key``, and under
    ``grown`` the shard there would be with one more.

    Keys of any type are hashed on the JVM; a null key is a key like any other;
    equal keys share a shard. No shuffle.
    """
    if out in df.columns or (grown and grown in df.columns):
        raise ValueError(f"the input already has a column {out} or {grown}")
    kinds = df.withColumn("_key", F.xxhash64(F.col(key)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names = df.columns
    added = f"{schema}, `{out}` int" + (f", `{grown}` int" if grown else "")

    def batches(it):
        import pyarrow as pa

        for batch in it:
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            more = [pa.array(jump(keys, shards))] + ([pa.array(jump(keys, shards + 1))] if grown else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*names, out, *([grown] if grown else [])])

    return kinds.mapInArrow(batches, added)


def shard_table(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Digest of the sharding of whole documents, a row for each document.

    doc_id, size (UTF-8 bytes of the text plus 1; a null text has none),
    text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard.
    Texts stay where they are; only digests are shuffled to number the slots.
    Repeated rows each get a slot. An empty table gives an empty result.
    """
    text = text_of("text")
    digest = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = stage(assign(digest, "doc_id", shards, "shard", "grown_shard"), "shards")
    slots = positions(placed, ["shard"], ["doc_id", "text_crc32"], out="slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: str, path: str, shards: int) -> None:
    """Write each shard into a folder of its own. Tasks write what they hold;
    no shard is gathered in one task."""
    assign(df, key, shards).write.partitionBy("shard").parquet(path)
