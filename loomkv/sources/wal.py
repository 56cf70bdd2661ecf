"""The write-ahead log as a Spark data source: ``shard_NNN.db`` files, one partition per file, never truncated.

The format has no marks to split a file at, so a shard is one task, which streams its file.  The data source reads
and writes a folder that every executor has mounted; ``read_wal_store`` takes any path that Spark reads.
"""

from __future__ import annotations

import glob
import io
import itertools
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from loomkv.sources.wire import decode_records, encode_record, valid_offset

SCHEMA = "shard int, offset long, op string, key binary, value binary, expiry_ns long, valid_offset long, file_size long"
SHARD = re.compile(r"shard_(\d+)\.db$")


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WalReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(f"{self.path}/shard_*.db"))] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        shard, size = int(SHARD.search(partition.path)[1]), os.path.getsize(partition.path)
        with open(partition.path, "rb", buffering=1 << 20) as f:
            end = valid_offset(f, size)
            f.seek(0)
            for at, op, key, value, expiry in decode_records(f, size):
                yield shard, at, op, key, value, expiry, end, size


class _Written(WriterCommitMessage):
    def __init__(self, files: dict[int, str]) -> None:
        self.files = files


class WalWriter(DataSourceWriter):
    """Appends records; rows of a shard must come from one task, in order.

    A task writes to files of its own attempt.  Only when all tasks are done does the commit put these behind the
    shards' files, one after the other, so a failed, repeated or speculative attempt leaves nothing in the log.
    """

    def __init__(self, path: str) -> None:
        self.path, self.job = path, f"{path}/.job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder = f"{self.job}/{uuid.uuid4().hex}"
        os.makedirs(folder, mode=0o700)
        files = {}
        for r in rows:
            f = files.get(r.shard) or files.setdefault(r.shard, open(f"{folder}/{r.shard}", "wb"))  # noqa: SIM115
            f.write(encode_record(bytes(r.key), None if r.op == "DEL" else bytes(r.value or b""), r.expiry_ns or 0))
        for f in files.values():
            f.flush()
            os.fsync(f.fileno())
            f.close()
        return _Written({shard: f.name for shard, f in files.items()})

    def commit(self, messages: list[_Written | None]) -> None:
        done: list[tuple[str, int]] = []
        try:
            for message in messages:
                for shard, part in (message.files if message else {}).items():
                    to = f"{self.path}/shard_{shard:03d}.db"
                    done.append((to, os.path.getsize(to) if os.path.exists(to) else 0))
                    if not done[-1][1]:
                        os.replace(part, to)
                        continue
                    with open(part, "rb") as source, open(to, "ab") as f:
                        shutil.copyfileobj(source, f, 1 << 20)
                        f.flush()
                        os.fsync(f.fileno())
        except BaseException:
            for to, size in done:
                if os.path.exists(to):
                    os.truncate(to, size)
            raise
        finally:
            shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


class WalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WalReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WalWriter(self.options["path"])


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WalSource)
    return spark.read.format("kvwal").load(path)


def read_wal_store(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from any store that Spark reads; a file of up to 2 GB is one row on its way."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard_*.db").load(path)

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for some_files in parts:
            for where, data in zip(some_files["path"], some_files["content"], strict=True):
                shard, size = int(SHARD.search(where)[1]), len(data)
                end = valid_offset(io.BytesIO(data), size)
                rows = ((shard, *x, end, size) for x in decode_records(io.BytesIO(data), size))
                while some := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame(some, columns=names)

    return files.select("path", "content").mapInPandas(decode, SCHEMA)


def write_wal(rows: DataFrame, path: str, shards: int) -> None:
    """Append (shard, seq, op, key, value, expiry_ns), each shard in order of ``seq``."""
    rows.sparkSession.dataSource.register(WalSource)
    ordered = rows.repartition(shards, "shard").sortWithinPartitions("shard", "seq")
    null = F.lit(None).cast("long")
    ordered.select("shard", null.alias("offset"), "op", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "expiry_ns", null.alias("valid_offset"), null.alias("file_size")).write.format("kvwal").mode("append").save(path)


def replay_wal(wal: DataFrame, now_ns: int) -> DataFrame:
    """State after a restart: expired SETs are skipped before the last record of each key is taken."""
    kept = wal.filter(~((F.col("op") == "SET") & (F.col("expiry_ns") != 0) & (F.col("expiry_ns") <= now_ns)))
    last = kept.groupBy("shard", "key").agg(F.max_by(F.struct("op", "value", "expiry_ns"), "offset").alias("m"))
    return last.filter("m.op = 'SET'").select("shard", "key", "m.value", "m.expiry_ns")
