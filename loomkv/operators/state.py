"""Key/value state as a query over the log: latest mutation per key, then tombstones, then expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkv.operators import crypto


def moment(as_of: str | Column) -> Column:
    return F.expr(f"timestamp_ntz '{as_of}'") if isinstance(as_of, str) else as_of


def latest(log: DataFrame, as_of=None) -> DataFrame:
    """The last mutation of each key up to ``as_of``: a partial and a final aggregate, so hot keys combine early."""
    rows = log.filter(F.col("op").isin("SET", "DEL"))
    if as_of is not None:
        rows = rows.filter(F.col("ts") <= moment(as_of))
    last = rows.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value", "expires_at"), "seq").alias("m"))
    return last.select("key", "m.seq", "m.op", "m.value", "m.expires_at")


def live(log: DataFrame, as_of) -> DataFrame:
    """Entries readable at ``as_of``; one that expires at that very moment still is."""
    return latest(log, as_of).filter((F.col("op") == "SET") & (F.col("expires_at").isNull() | (moment(as_of) <= F.col("expires_at")))).drop("op")


def expired(log: DataFrame, as_of) -> DataFrame:
    """Entries not deleted whose time is over: what conditional deletion would remove."""
    return latest(log, as_of).filter((F.col("op") == "SET") & (F.col("expires_at") < moment(as_of))).drop("op")


def deleted(log: DataFrame, as_of) -> DataFrame:
    return latest(log, as_of).filter("op = 'DEL'").select("key", "seq")


def replay(log: DataFrame, as_of) -> DataFrame:
    """State after replaying the log at ``as_of``: expired SETs are skipped first, so older values may come back."""
    skipped = (F.col("op") == "SET") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= moment(as_of))
    return latest(log.filter(~skipped), as_of).filter("op = 'SET'").drop("op")


def get(log: DataFrame, key: str, as_of, capacity: int | None = None) -> DataFrame:
    """One key's live entry; with ``capacity`` only where the value fits. The key filter reaches the scan."""
    out = live(log.filter(F.col("key") == key), as_of)
    return out if capacity is None else out.filter(F.octet_length("value") <= capacity)


def get_many(log: DataFrame, keys: list[str], as_of, capacity: int | None = None, secret: bytes | None = None) -> DataFrame:
    """(key, found, value) of each of ``keys``; the keys are filtered in the scan.

    With ``capacity``, a value that doesn't fit the reader's buffer is not found; one that is stored encrypted under
    ``secret`` is opened into a buffer that grows, so its length doesn't matter.  A value that fails to open is not
    found.
    """
    asked = log.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "asked string")
    held = live(log.filter(F.col("key").isin(*keys)), as_of)
    value = F.col("value") if secret is None else crypto.decrypt(F.col("value"), secret).cast("string")
    found = F.col("key").isNotNull() & value.isNotNull()
    if capacity is not None and secret is None:
        found &= F.octet_length("value") <= capacity
    out = asked.join(held, F.col("asked") == F.col("key"), "left")
    return out.select(F.col("asked").alias("key"), found.alias("found"), F.when(found, value).alias("value"))


def count_deleted(log: DataFrame, keys: DataFrame, as_of) -> DataFrame:
    """How many of ``keys`` (repeats count once) a multi-key delete would remove."""
    return live(log, as_of).join(keys.select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("n_deleted"))


def compact(log: DataFrame) -> DataFrame:
    """The log with only the last mutation of each key, deletions dropped (extension)."""
    return latest(log).filter("op = 'SET'")
