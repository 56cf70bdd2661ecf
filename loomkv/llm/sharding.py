"""Sharding by minimax contiguous partition.

Rows with equal texts are one atomic group; groups are ordered by the hash of their text.  The smallest capacity
for which a greedy pass needs no more than the given number of shards is found by binary search, and the order is
cut there.  Where one group alone forces that capacity, it takes a shard of its own and the search goes on for what
lies before and after it, so a giant group doesn't leave other shards empty.  The driver holds a summary of the order
only: sums over hash prefixes, refined by further bits just where some cut can still fall, until greedy on the
summary and on the groups agree.

Defined results: a null text has no bytes and all null texts are one group; groups whose 64-bit
hashes collide count as one; a group larger than the mean shard has a shard as large as itself; repeated rows get
slots of their own; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkv.llm.common import materialise, table

ROW_BYTES = 16
FIRST_BITS, STEP_BITS = 16, 8


def greedy(sums: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Cuts (numbers of units before each shard's end) when filling each shard up to ``capacity``, or None."""
    total = np.concatenate(([0], np.cumsum(sums)))
    cuts, at = [], 0
    for _ in range(shards):
        nxt = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
        if nxt == at and at < len(sums):
            return None
        at = nxt
        cuts.append(at)
        if at == len(sums):
            return np.array(cuts)
    return None


def smallest_capacity(sums: np.ndarray, shards: int) -> int:
    """The least capacity for which ``greedy`` succeeds."""
    low, high = max(int(sums.max()), -(-int(sums.sum()) // shards)), int(sums.sum())
    while low < high:
        mid = (low + high) // 2
        if greedy(sums, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _needed(sums: np.ndarray, capacity: int) -> int:
    """Shards that a greedy pass takes."""
    total = np.concatenate(([0], np.cumsum(sums)))
    at = n = 0
    while at < len(sums):
        at = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
        n += 1
    return n


def allot(sums: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """(from, to, shards, capacity) of consecutive stretches; a unit that alone forces the capacity is one of its own."""
    alone: list[int] = []
    while True:
        edges = [-1, *sorted(alone), len(sums)]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
        left = shards - len(alone)
        if not parts:
            break
        biggest, whole = max(int(sums[a:b].max()) for a, b in parts), sum(int(sums[a:b].sum()) for a, b in parts)
        low, high = max(biggest, -(-whole // left)), whole
        while low < high:
            mid = (low + high) // 2
            if sum(_needed(sums[a:b], mid) for a, b in parts) > left:
                low = mid + 1
            else:
                high = mid
        if biggest < low:
            break
        alone.append(next(i for a, b in parts for i in range(a, b) if sums[i] == biggest))
    out = [(i, i + 1, 1, int(sums[i])) for i in alone]
    if parts:
        taken = {x: _needed(sums[x[0] : x[1]], low) for x in parts}
        own = {x: smallest_capacity(sums[x[0] : x[1]], k) for x, k in taken.items()}
        for _ in range(left - sum(taken.values())):
            x = max(own, key=own.get)
            if own[x] == sums[x[0] : x[1]].max():
                break
            taken[x] += 1
            own[x] = smallest_capacity(sums[x[0] : x[1]], taken[x])
        out += [(*x, taken[x], own[x]) for x in parts]
    return sorted(out)


def _uncertain(sums: np.ndarray, atomic: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Units that may have a cut inside: bounds of each greedy cut for any capacity from ``low`` to ``high``."""
    ends = np.cumsum(sums)
    starts, bounds = ends - sums, np.concatenate(([0], ends))
    out = np.zeros(len(sums), bool)
    first = last = 0
    for _ in range(shards):
        first = int(bounds[np.searchsorted(bounds, first + low, "right") - 1])
        last = min(last + high, int(ends[-1]))
        unit = int(np.searchsorted(ends, last, "right"))
        if unit < len(sums) and atomic[unit]:
            last = int(starts[unit])
        out |= (starts < last) & (ends > first) & ~atomic
    return out


def cut_points(rows: DataFrame, shards: int) -> tuple[list[int], int]:
    """(cuts, capacity): cuts[k] is the first hash, as a signed long, of shard k + 1 over ``rows`` (h, size)."""

    def summary(part: DataFrame, bits: int) -> pd.DataFrame:
        grouped = part.groupBy(F.shiftright("h", 64 - bits).alias("unit"))
        return grouped.agg(F.sum("size").alias("sum"), F.min("h").alias("low"), F.max("h").alias("high")).toPandas().assign(bits=bits)

    # at most 2^16 rows; later rounds look into the few units in which a cut can fall, 2^8 rows for each
    units = summary(rows, FIRST_BITS)
    if not len(units):
        return [], 0
    while True:
        units = units.sort_values("low", ignore_index=True)
        sums = units["sum"].to_numpy(np.int64)
        atomic = (units["low"] == units["high"]).to_numpy()
        split = ~atomic & (sums > sums.sum() // (16 * shards))  # heavy units first: one group may make them so
        if not split.any():
            made = allot(sums, shards)
            for a, b, k, high in made:
                low = max(-(-int(sums[a:b].sum()) // k), int(sums[a:b][atomic[a:b]].max(initial=0)))
                split[a:b] |= _uncertain(sums[a:b], atomic[a:b], low, high, k) if b - a > 1 else ~atomic[a:b]
        if not split.any():
            break
        fresh = [units[~split]]
        for bits, part in units[split].groupby("bits"):
            asked = F.broadcast(rows.sparkSession.createDataFrame([(int(x),) for x in part["unit"]], "unit long"))
            inside = rows.withColumn("unit", F.shiftright("h", 64 - int(bits))).join(asked, "unit", "left_semi")
            fresh.append(summary(inside, min(64, int(bits) + STEP_BITS)))
        units = pd.concat(fresh, ignore_index=True)
    cuts = [a + int(c) for a, b, k, high in made for c in greedy(sums[a:b], high, k)]
    lows = units["low"].to_list()
    return [int(lows[c]) for c in cuts if c < len(lows)], max(x[-1] for x in made)


def shard_of(h: Column, cuts: list[int]) -> Column:
    """The shard of a hash: the number of cuts at or before it."""
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    return F.size(F.filter(bounds, lambda c: c <= h))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots count from 0 without gaps in each shard."""
    text = F.coalesce("text", F.lit(""))
    h = F.when(F.col("text").isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64("text"))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    rows = materialise(docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("h"), F.xxhash64("doc_id", h, F.monotonically_increasing_id()).alias("salt")), "sized")
    cuts, _ = cut_points(rows.select("h", "size"), shards)
    buckets = min(4096, max(64, rows.count() // 2_000_000))
    put = rows.withColumns({"shard": shard_of(F.col("h"), cuts), "bucket": F.pmod("salt", F.lit(buckets)).cast("int")})
    # a row per shard and bucket
    counts = put.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = F.broadcast(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    order = W.partitionBy("shard", "bucket").orderBy("doc_id", "salt")
    numbered = put.withColumn("number", F.row_number().over(order)).join(firsts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))


def write_shards(docs: DataFrame, where: str, shards: int = 40) -> None:
    """Write ``docs`` as Parquet in folders ``shard=0`` and so on; equal texts share a folder."""
    h = F.when(F.col("text").isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64("text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + ROW_BYTES
    cuts, _ = cut_points(materialise(docs.select(h.alias("h"), size.alias("size")), "sized"), shards)
    docs.withColumn("shard", shard_of(h, cuts)).write.partitionBy("shard").parquet(where)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
