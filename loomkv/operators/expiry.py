"""The timing wheel as arithmetic on registrations, and what its firings find and remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkv.functions.moments import epoch_micros, epoch_millis, has_zone, moment_of
from loomkv.functions.routing import shard
from loomkv.operators.asof import one, per_shard, resident, with_previous, with_removal

#: Events of one key are cut into blocks of this many microseconds.
BLOCK_US = 6 * 3_600_000_000
ORDER = ("ts", "kind", "seq")


def registrations(log: DataFrame, interval_ms: int, slots: int, shards: int, capacity: int = 512) -> DataFrame:
    """Each SET with a ttl: ticks from the epoch, steps, slot, firing tick, and whether its slot was full.

    Ranks count the registrations of a (shard, firing tick); a tick is bounded by what one interval registers.
    An interval or a number of slots of zero or less switches the wheel off: nothing registers.
    """
    if interval_ms <= 0 or slots <= 0:
        return registrations(log.limit(0), 1, 1, shards, capacity)
    t = log.filter((F.col("op") == "SET") & (F.col("ttl_ms") > 0))
    tick = F.floor(epoch_millis(t, "ts") / interval_ms)
    rows = t.select("seq", "key", "ts", "ttl_ms", "expires_at", shard(F.col("key"), shards).alias("shard"), tick.alias("tick"), F.least(F.floor(F.col("ttl_ms") / interval_ms), F.lit(slots - 1)).alias("steps"))
    rows = rows.withColumns({"slot": F.pmod(F.col("tick") + F.col("steps"), F.lit(slots)).cast("int"), "fire_tick": F.col("tick") + F.col("steps") + 1})
    return rows.withColumn("overflow", F.row_number().over(W.partitionBy("shard", "fire_tick").orderBy("seq")) > capacity)


def events(log: DataFrame, interval_ms: int, slots: int, shards: int, probes: tuple[str, ...] = ("GET",), capacity: int = 512) -> DataFrame:
    """Commands and firings (op ``FIRE``, seq that of the registration) in one order, with what each of them meets.

    A firing comes after the commands of its very moment; firings of one moment go by registration.  Timestamps must
    not fall as ``seq`` rises.
    """
    fire = registrations(log, interval_ms, slots, shards, capacity).filter(~F.col("overflow"))
    none = F.lit(None)
    moment = moment_of(F.col("fire_tick") * interval_ms, has_zone(log, "ts"))
    fires = fire.select(moment.alias("ts"), F.lit(1).alias("kind"), "seq", F.lit("FIRE").alias("op"), "key", none.cast("string").alias("value"), none.cast("timestamp_ntz").alias("expires_at"), "fire_tick")
    commands = log.select("ts", F.lit(0).alias("kind"), "seq", "op", "key", "value", "expires_at", none.cast("long").alias("fire_tick"))
    rows = commands.unionByName(fires)
    return with_removal(with_previous(rows, BLOCK_US, ORDER, epoch_micros(rows, "ts")), (*probes, "FIRE"), ORDER)


def _evicts() -> Column:
    return (F.col("op") == "FIRE") & F.col("late") & (F.col("at") == F.col("first"))


def fired(log: DataFrame, interval_ms: int, slots: int, shards: int) -> DataFrame:
    """What each firing finds at its moment: ``evict`` an entry whose time is over, ``early`` its own entry before that,
    ``stale`` a newer one before that, ``gone`` nothing (deleted, or removed before by a read or another firing)."""
    found = events(log, interval_ms, slots, shards).filter("op = 'FIRE'")
    outcome = F.when(_evicts(), "evict").when(~resident() | F.col("late"), "gone").when(F.col("version") == F.col("seq"), "early").otherwise("stale")
    return found.select("seq", "key", "fire_tick", outcome.alias("outcome"))


def counters_evicting(log: DataFrame, interval_ms: int, slots: int, shards: int, level: str = "engine") -> DataFrame:
    """Counters with the wheel on: a key that a firing evicted is a miss for the next read, not an expiry.

    ``popped`` counts firings, whatever they find; ``evicted`` those that remove an entry, each of them a command.
    """
    rows = events(log, interval_ms, slots, shards, ("GET",) if level == "engine" else ("GET", "SET"))
    fire = F.col("op") == "FIRE"
    probe, first = F.col("probe") & ~fire, F.col("late") & (F.col("at") == F.col("first"))
    return per_shard(
        rows, shards,
        hits=one(probe & F.col("there") & ~F.col("late")),
        misses=one(probe & (~F.col("there") | (F.col("late") & ~first))),
        expired_passive=one(probe & first),
        evicted=one(_evicts()),
        popped=one(fire),
        total_commands=one(probe) + one(F.col("op") == "SET") + one((F.col("op") == "DEL") & resident()) + one(_evicts()),
    )
