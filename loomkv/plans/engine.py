"""A façade over one log: point access, the SQL subset, state at a moment, counters, all by the settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkv.functions import replies
from loomkv.functions.moments import epoch_micros
from loomkv.functions.routing import shard
from loomkv.functions.text import parse_sql
from loomkv.operators import asof, crypto, expiry, memory, state
from loomkv.plans.config import EngineConfig
from loomkv.plans.log import with_expiry
from loomkv.sources import wal


class Engine:
    """``log`` (plain values) is immutable: writes return an engine over a longer log.

    With encryption on, what is kept (``stored``) holds sealed values, which reads open again; the write-ahead log
    holds plain ones.  With a memory limit, SETs beyond a shard's share of it are refused and don't reach the state.
    """

    def __init__(self, log: DataFrame, config: EngineConfig | int = 8) -> None:
        self.config = EngineConfig(shards=config, evict=False) if isinstance(config, int) else config
        self.log, self.shards = log, self.config.shards
        self.secret = self.config.encryption_key.encode() if self.config.encrypt else None

    @property
    def stored(self) -> DataFrame:
        """The log as the store keeps it: refused SETs left out, values sealed."""
        log = self.log
        if self.config.max_mem_bytes:
            refused = self.memory().filter("NOT accepted").select(F.col("seq").alias("refused"))
            log = log.join(refused, F.col("seq") == F.col("refused"), "left_anti")
        return log.withColumn("value", crypto.encrypt(F.col("value"), self.secret)) if self.secret else log

    def memory(self) -> DataFrame:
        """(seq, shard, accepted, allocated_bytes) of each mutation under the memory limit."""
        overhead = crypto.OVERHEAD if self.secret else 0
        return memory.with_ceiling(self.log, self.shards, self.config.max_mem_bytes or 1 << 62, overhead)

    def _opened(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("value", crypto.decrypt(F.col("value"), self.secret).cast("string")).filter("value IS NOT NULL") if self.secret else rows

    def get(self, key: str, as_of: str) -> DataFrame:
        return self._opened(state.get(self.stored, key, as_of))

    def get_many(self, keys: list[str], as_of: str, capacity: int | None = None) -> DataFrame:
        return state.get_many(self.stored, keys, as_of, capacity, self.secret)

    def delete_many(self, keys: list[str], as_of: str) -> DataFrame:
        """How many of ``keys`` a multi-key delete would remove."""
        return state.count_deleted(self.stored, self.log.sparkSession.createDataFrame([(k,) for k in keys], "key string"), as_of)

    def ping(self, text: str | None = None) -> str:
        row = self.log.sparkSession.range(1).select(replies.keyless(F.lit("PING"), F.lit(1 + (text is not None)), F.lit(text).cast("string")).alias("reply"))
        return row.first().reply

    def _append(self, seq: int, ts: str, op: str, key: str, value: str | None, ttl_ms: int | None) -> Engine:
        spark = self.log.sparkSession
        row = spark.createDataFrame([(seq, ts, op, key, value, ttl_ms)], "seq long, ts string, op string, key string, value string, ttl_ms long")
        row = with_expiry(row.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
        return Engine(self.log.unionByName(row), self.config)

    def set(self, seq: int, ts: str, key: str, value: str, ttl_ms: int = 0) -> Engine:
        return self._append(seq, ts, "SET", key, value, ttl_ms)

    def delete(self, seq: int, ts: str, key: str) -> Engine:
        return self._append(seq, ts, "DEL", key, None, None)

    def sql(self, text: str, seq: int, as_of: str) -> DataFrame | Engine:
        """A SELECT gives rows; an INSERT or DELETE an engine; a bad statement ValueError."""
        p = self.log.sparkSession.range(1).select(F.inline(F.array(parse_sql(F.lit(text))))).first()
        if p.error:
            raise ValueError(p.error)
        if p.op == "GET":
            return self.get(p.key, as_of)
        return self.set(seq, as_of, p.key, p.value, p.ttl_ms) if p.op == "SET" else self.delete(seq, as_of, p.key)

    def live(self, as_of: str) -> DataFrame:
        return self._opened(state.live(self.stored, as_of))

    def counters(self, level: str = "engine") -> DataFrame:
        """Counters per shard; with eviction on, the wheel takes part."""
        if not self.config.evict:
            return asof.counters(self.stored, self.shards, level)
        return expiry.counters_evicting(self.stored, self.config.evict_interval_ms, self.config.wheel_slots, self.shards, level)

    def save(self) -> None:
        """Append the log to the write-ahead log, if the settings keep one."""
        if not self.config.persist:
            return
        ns = F.coalesce(epoch_micros(self.log, "expires_at") * 1000, F.lit(0).cast("long"))
        rows = self.log.filter(F.col("op").isin("SET", "DEL")).select(shard(F.col("key"), self.shards).alias("shard"), "seq", "op", "key", "value", ns.alias("expiry_ns"))
        wal.write_wal(rows, self.config.data_dir, self.shards)

    def restored(self, now_ns: int) -> DataFrame:
        """(shard, key, value, expiry_ns) that a restart reads from the write-ahead log."""
        return wal.replay_wal(wal.read_wal(self.log.sparkSession, self.config.data_dir), now_ns)
