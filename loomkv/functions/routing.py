"""FNV-1a hashing and shard routing as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a32(key: Column) -> Column:
    """32-bit FNV-1a of the bytes of a string or binary column; an empty key gives the offset basis."""
    chars = F.split(F.decode(key.cast("binary"), "ISO-8859-1"), "")  # a character for each byte; "" for an empty key
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295).cast("long"))
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: F.when(c == "", h).otherwise(step(h, c)))


def shard(key: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("at least one shard")
    return F.pmod(fnv1a32(key), F.lit(n)).cast("int")
