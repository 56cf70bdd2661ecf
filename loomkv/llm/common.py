"""Helpers shared by the training-data operators.

Every operator takes whole tables, treats a null text as the contract of that operator says, and keeps
rows that repeat.  Intermediate tables go to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.sources.folders import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_written: list[tuple[object, object]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove_written() -> None:
    while _written:
        fs, path = _written.pop()
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


atexit.register(_remove_written)


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    where = f"{shared_dir(spark)}/loomkv/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    _written.append((path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path))
    return where


#: Rows that go to a Python worker at a time where whole texts go there; the session's number, 10,000, takes tens of MB.
ARROW_ROWS = 2000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Return what Arrow and the C library hold free: a Python worker may wait long for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Jobs that run inside send ``ARROW_ROWS`` rows at a time to Python workers."""
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before)


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    where = scratch(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII takes the quick built-in; other texts go through translate."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


def parts_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for a given number of parts: the session's, or more where Catalyst's size of the input asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # Catalyst gives a huge number where it can't tell
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // bytes_each if known else 0)


def broadcast_if(df: DataFrame, size: int, bound: int) -> DataFrame:
    """Broadcast ``df`` only when its measured size (bytes or rows) is within ``bound``; beyond it the join shuffles."""
    return F.broadcast(df) if size <= bound else df


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, size: str, share: float = 0.001) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row for each ``key`` and in ``size`` the rows that it has.

    Keys with over ``share`` of all rows are at most its inverse in number: they are broadcast, so their rows stay where
    they are; the others have no hot key and are shuffled.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    hot, cold = keyed.filter(F.col(size) > share * total), keyed.filter(F.col(size) <= share * total)
    at_home = rows.join(F.broadcast(hot), key)
    return at_home.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def size_of(df: DataFrame) -> int:
    """Bytes of a written table: its columns' own sizes and 16 for each row."""
    each = F.lit(16).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            each = each + F.coalesce(F.octet_length(name), F.lit(0))
        else:
            each = each + (F.octet_length(F.to_json(F.struct(name))) if kind.startswith(("array", "struct")) else 8)
    return df.agg(F.sum(each)).first()[0] or 0


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` names it inside another lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)
