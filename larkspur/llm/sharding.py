"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, least movement when shards are added.

The stable key is the 64-bit hash of doc_id. Null ids share one shard; null texts have size 1 and checksum 0; repeated
rows each get a slot of their own, ties in any order. An empty table gives no rows. Texts of any length are read whole; columns
other than doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import positions, stage, unstage

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key."""
    key = keys.astype(np.uint64).copy()
    at, ahead = np.full(len(key), -1, dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            key[live] = key[live] * _STEP + np.uint64(1)
            ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[ahead[live] < shards]
    return at


def _jump_pair(keys: pd.Series, shards: pd.Series) -> pd.DataFrame:
    raw = keys.to_numpy(dtype=np.int64).view(np.uint64)
    n = int(shards.iloc[0]) if len(shards) else 1
    return pd.DataFrame({"shard": jump(raw, n).astype(np.int32), "grown": jump(raw, n + 1).astype(np.int32)})


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; slots follow doc_id within a shard."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    pair = F.pandas_udf(_jump_pair, "struct<shard:int,grown:int>")
    rows = (
        docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumn("_j", pair(F.xxhash64("doc_id"), F.lit(shards)))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_j.shard").alias("shard"), F.col("_j.grown").alias("grown_shard"))
    )
    rows = stage(rows, "shard-rows")  # the range bounds would compute them a second time
    numbered, staged = positions(rows, ["shard", "doc_id", "text_crc32", "size"], "shards")
    unstage(rows)
    starts, before = [], 0
    for shard, n in sorted(staged.groupBy("shard").count().collect()):  # a row for each shard
        starts.append((shard, before))
        before += n
    start = F.broadcast(spark.createDataFrame(starts, "shard int, _start long"))
    return numbered.join(start, "shard").select("doc_id", "size", "text_crc32", "law", "shard", (F.col("pos") - F.col("_start")).alias("slot"), "grown_shard")
