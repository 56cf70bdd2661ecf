"""The key/value state kept by Structured Streaming, a state value with an event-time timeout for each bucket of keys.

A call of Python takes milliseconds, so one is made for a bucket and not for a key; in turn a batch writes the entries of
all buckets anew that it touches.

Rows may come late by ``delay`` at most: the watermark is the latest timestamp seen in the batches before, less
``delay``, and rows that are older than it are dropped, in whichever batch they come.  Within that bound the order of
arrival doesn't matter: the mutation of the highest ``seq`` wins, and a deletion stays as a tombstone until the
watermark has passed it, so an older SET that comes after it changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomkv.functions.moments import epoch_micros, epoch_millis
from loomkv.plans.log import commands
from loomkv.sources.folders import shared_dir

OUT = "key string, seq long, op string, value string, expires_ms long"
COLUMNS = [x.split()[0] for x in OUT.split(", ")]
ENTRIES = "key array<string>, seq array<long>, op array<string>, ts_ms array<long>, value array<string>, expires_ms array<long>"
#: Keys are dealt out to so many buckets, a state value each; a checkpoint is bound to their number.
BUCKETS = 4096
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def bucket_changes(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The entries of a bucket's keys that change, and ``EXPIRED`` for those whose end the watermark has passed.

    ``state`` holds a list for each field of ``ENTRIES``; the timeout is the first end among them.
    """
    watermark = state.getCurrentWatermarkMs()
    held = {x[0]: x for x in zip(*state.get, strict=True)} if state.exists else {}
    new: dict[str, tuple] = {}
    if not state.hasTimedOut:
        for part in parts:
            part = part[part["ts_ms"] >= watermark]
            expires = part["expires_ms"].astype("Int64").astype(object)
            fields = (part["key"], part["seq"], part["op"], part["ts_ms"], part["value"], expires.where(expires.notna(), None))
            for row in zip(*(x.tolist() for x in fields), strict=True):
                if row[0] not in new or row[1] > new[row[0]][1]:
                    new[row[0]] = row
    new = {key: row for key, row in new.items() if key not in held or held[key][1] <= row[1]}
    held |= new
    out = [(key, seq, op, value, expires) for key, seq, op, _, value, expires in new.values()]
    ends = {key: ts if op == "DEL" else expires for key, _, op, ts, _, expires in held.values()}
    over = [held.pop(key) for key, end in ends.items() if end is not None and end < watermark]
    out += [(key, seq, "EXPIRED", value, expires) for key, seq, op, _, value, expires in over if op != "DEL"]
    if not held:
        state.remove()
    elif new or over:
        state.update(tuple(map(list, zip(*held.values(), strict=True))))
    first = min((ends[key] for key in held if ends[key] is not None), default=None)
    if first is not None:
        state.setTimeoutTimestamp(max(first, 1))  # each call clears the one before
    if out:
        yield pd.DataFrame(out, columns=COLUMNS, dtype=object)


def stream_state(log: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Change stream of the state of a streaming log (seq, ts, op, key, value, expires_at).

    The RocksDB state store keeps it out of the heap: ``spark.sql.streaming.stateStore.providerClass``.
    """
    log = log.withColumns({"ts_ms": epoch_millis(log, "ts"), "expires_ms": epoch_millis(log, "expires_at")})
    rows = log.withColumn("ts", F.timestamp_micros(epoch_micros(log, "ts"))).withWatermark("ts", delay)
    # GETs move the watermark but don't reach the state
    changes = rows.filter(F.col("op").isin("SET", "DEL")).select("seq", "ts", "ts_ms", "op", "key", "value", "expires_ms")
    changes = changes.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return changes.groupBy("bucket").applyInPandasWithState(bucket_changes, OUT, ENTRIES, "update", GroupStateTimeout.EventTimeTimeout)


def read_commands(spark: SparkSession, folder: str, schema, max_bytes: str | None = None, max_files: int | None = None) -> DataFrame:
    """A streaming log over Parquet files of events that arrive in ``folder``.

    ``max_bytes`` and ``max_files`` bound what one batch takes, so a backlog doesn't flood the state.
    """
    reader = spark.readStream.schema(schema)
    for name, value in (("maxBytesPerTrigger", max_bytes), ("maxFilesPerTrigger", max_files)):
        if value is not None:
            reader = reader.option(name, value)
    return commands(reader.parquet(folder))


def run_available(spark: SparkSession, changes: DataFrame, checkpoint: str, out: str) -> None:
    """Take in all that is there now, each batch written once to a folder of its own under ``out``."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = changes.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint)
        writer.foreachBatch(lambda part, n: part.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def run_parts(spark: SparkSession, parts: list[DataFrame], delay: str) -> DataFrame:
    """All changes when ``parts`` (events) arrive one after the other, the stream stopped and started anew between them."""
    folder = f"{shared_dir(spark)}/loomkv/stream-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/events")
        log = read_commands(spark, f"{folder}/events", part.schema)
        run_available(spark, stream_state(log, delay), f"{folder}/checkpoint", f"{folder}/changes")
    return spark.read.schema(f"{OUT}, batch long").parquet(f"{folder}/changes")


def op_rates(log: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Commands per window and kind; batch or streaming (extension)."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if log.isStreaming else rows
    return rows.groupBy(F.window("ts", width), "op").agg(F.count(F.lit(1)).alias("n"))
