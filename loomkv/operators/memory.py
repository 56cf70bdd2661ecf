"""Resident bytes over the log, with and without a ceiling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkv.functions.routing import shard
from loomkv.operators.asof import with_previous

BLOCK = 1 << 16


def running_total(rows: DataFrame, amount: str, order: str, out: str, block: int = BLOCK) -> DataFrame:
    """Prefix sums over one global order: inside blocks, over the blocks of a block of blocks, and over those.

    The last window sees a row for each ``block`` squared of the order.
    """
    keyed = rows.withColumn("blk", F.floor(F.col(order) / block))
    sums = keyed.groupBy("blk").agg(F.sum(amount).alias("s")).withColumn("top", F.floor(F.col("blk") / block))
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy("top").agg(F.sum("s").alias("t")).select("top", before(W.orderBy("top"), "t").alias("top_base"))
    base = sums.withColumn("base", before(W.partitionBy("top").orderBy("blk"), "s")).join(tops, "top").select("blk", (F.col("base") + F.col("top_base")).alias("base"))
    own = W.partitionBy("blk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return keyed.withColumn("own", F.sum(amount).over(own)).join(base, "blk").withColumn(out, F.col("own") + F.col("base")).drop("own", "base", "blk")


def deltas(log: DataFrame) -> DataFrame:
    """Signed change of resident bytes and keys of each mutation; nothing is reclaimed before it is replaced."""
    held = F.coalesce(F.col("prev.op") == "SET", F.lit(False))
    length = lambda value: F.octet_length("key") + F.coalesce(F.octet_length(value), F.lit(0))
    size = F.when(F.col("op") == "SET", length("value")).otherwise(0).cast("long")
    before = F.when(held, length("prev.value")).otherwise(0).cast("long")
    m = with_previous(log.filter(F.col("op").isin("SET", "DEL")))
    return m.select("seq", "key", (size - before).alias("delta"), ((F.col("op") == "SET").cast("long") - held.cast("long")).alias("key_delta"))


def timeline(log: DataFrame) -> DataFrame:
    return running_total(deltas(log), "delta", "seq", "allocated_bytes").select("seq", "delta", "allocated_bytes")


def with_ceiling(log: DataFrame, shards: int, max_bytes: int, overhead: int = 0) -> DataFrame:
    """(seq, shard, accepted, allocated_bytes) of each mutation when a shard rejects SETs beyond its share.

    A rejected SET changes what later ones see, so each shard is walked in order by one task, which streams its
    batches and holds the sizes of the shard's resident keys: these are at most ``max_bytes / shards`` bytes of entries,
    so the ceiling itself bounds the task.  Several shards may share a task.
    """
    share = max_bytes // shards

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict[str, int]] = {}
        total: dict[int, int] = {}
        for rows in parts:
            out = []
            for s, seq, op, key, size in zip(rows["shard"], rows["seq"], rows["op"], rows["key"], rows["size"], strict=True):
                keys, at = held.setdefault(s, {}), total.get(s, 0)
                fits = op == "DEL" or at + size <= share
                if fits:
                    at += (0 if op == "DEL" else size) - keys.pop(key, 0)
                    if op == "SET":
                        keys[key] = size
                total[s] = at
                out.append((seq, s, fits, at))
            yield pd.DataFrame(out, columns=["seq", "shard", "accepted", "allocated_bytes"])

    size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + overhead).cast("long")
    rows = log.filter("op <> 'GET'").select(shard(F.col("key"), shards).alias("shard"), "seq", "op", "key", size.alias("size"))
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "seq").mapInPandas(walk, "seq long, shard int, accepted boolean, allocated_bytes long")
