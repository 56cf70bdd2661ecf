"""As-of resolution of commands against the mutations before them, and the counters that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkv.functions.routing import shard

#: Commands of one key are cut into blocks of this many sequence numbers, so a hot key spreads over tasks.
BLOCK = 1 << 20


def with_previous(log: DataFrame, block: int = BLOCK, order: tuple[str, ...] = ("seq",), place: Column | None = None) -> DataFrame:
    """Each command with ``prev``, the last mutation of its key before it in ``order``.

    ``place`` is a number that never falls in that order (by default ``seq``).  The last mutation of every (key,
    block of places) is carried into the key's later blocks; a window then runs inside each block only.
    """
    rows = log.withColumn("block", F.floor((F.col("seq") if place is None else place) / block))
    changes = F.col("op").isin("SET", "DEL")
    m = F.when(changes, F.struct("seq", "op", "value", "expires_at"))
    ends = rows.groupBy("key", "block").agg(F.max_by(m, F.when(changes, F.struct(*order))).alias("m"))
    earlier = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select("key", "block", F.last("m", True).over(earlier).alias("carried"))
    inside = W.partitionBy("key", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("own", F.last(m, True).over(inside)).join(carry, ["key", "block"])
    return out.withColumn("prev", F.coalesce("own", "carried")).drop("own", "carried", "block")


def live_before() -> Column:
    """Whether ``prev`` is an entry that the command can read."""
    p = F.col("prev")
    return F.coalesce((p["op"] == "SET") & (p["expires_at"].isNull() | (F.col("ts") <= p["expires_at"])), F.lit(False))


def get_results(log: DataFrame) -> DataFrame:
    """(seq, key, hit, value) of every GET."""
    gets = with_previous(log).filter("op = 'GET'").withColumn("hit", live_before())
    return gets.select("seq", "key", "hit", F.when(F.col("hit"), F.col("prev.value")).alias("value"))


def one(c: Column) -> Column:
    """1 where ``c`` holds, else 0."""
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def with_removal(resolved: DataFrame, probes: tuple[str, ...], order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rows of ``with_previous`` with ``probe``, ``there``, ``late`` and ``first``.

    An expired entry is removed by the first row of ``probes`` that finds it over; ``late`` marks the rows that come
    when the entry's time is over, ``first`` is the order of the one that removes it.
    """
    p = F.col("prev")
    rows = resolved.withColumns({"probe": F.col("op").isin(*probes), "there": F.coalesce(p["op"] == "SET", F.lit(False)), "version": p["seq"], "at": F.struct(*order)})
    rows = rows.withColumn("late", F.col("probe") & F.col("there") & F.coalesce(F.col("ts") > p["expires_at"], F.lit(False)))
    gone = rows.filter("late").groupBy(F.col("key").alias("g_key"), F.col("version").alias("g_version")).agg(F.min("at").alias("first"))
    return rows.join(gone, (F.col("key") == F.col("g_key")) & (F.col("version") == F.col("g_version")), "left").drop("g_key", "g_version")


def resident() -> Column:
    """Whether the entry before a row of ``with_removal`` is still in the store."""
    return F.col("there") & (F.col("first").isNull() | (F.col("first") >= F.col("at")))


def classified(log: DataFrame, level: str = "engine") -> DataFrame:
    """Each command with its effect on the counters, active eviction off.

    ``engine``: GETs probe. ``shard``: a SET probes too, before it writes. The first probe of an expired entry
    removes it and is no miss; probes after that find nothing.
    """
    rows = with_removal(with_previous(log), ("GET",) if level == "engine" else ("GET", "SET"))
    first_late = F.col("late") & (F.col("at") == F.col("first"))
    return rows.select(
        "seq", "ts", "key", "op", "value",
        one(F.col("probe") & F.col("there") & ~F.col("late")).alias("hit"),
        one(F.col("probe") & (~F.col("there") | (F.col("late") & ~first_late))).alias("miss"),
        one(first_late).alias("expired"),
        (one(F.col("probe")) + one(F.col("op") == "SET") + one((F.col("op") == "DEL") & resident())).alias("commands"),
    )


def per_shard(rows: DataFrame, shards: int, **sums: Column) -> DataFrame:
    """Sums per shard: by key first, so each key is hashed once."""
    by_key = rows.groupBy("key").agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    return by_key.groupBy(shard(F.col("key"), shards).alias("shard")).agg(*(F.sum(name).alias(name) for name in sums))


def counters(log: DataFrame, shards: int, level: str = "engine") -> DataFrame:
    return per_shard(classified(log, level), shards, hits=F.col("hit"), misses=F.col("miss"), expired_passive=F.col("expired"), total_commands=F.col("commands"))
