"""Timestamps as numbers since 1970, whatever the session's time zone.

A timestamp without a zone counts as UTC; casting it to one with a zone would take the session's zone instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType


def has_zone(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, TimestampType)


def _epoch(df: DataFrame, name: str, a_second: int) -> Column:
    seconds = F.unix_date(F.col(name).cast("date")).cast("long") * 86_400 + F.hour(name) * 3600 + F.minute(name) * 60
    return seconds * a_second + (F.extract(F.lit("SECOND"), F.col(name)) * a_second).cast("long")


def epoch_micros(df: DataFrame, name: str) -> Column:
    return F.unix_micros(name) if has_zone(df, name) else _epoch(df, name, 1_000_000)


def epoch_millis(df: DataFrame, name: str) -> Column:
    return F.unix_millis(name) if has_zone(df, name) else _epoch(df, name, 1000)


def moment_of(millis: Column, zone: bool) -> Column:
    """The timestamp of ``millis`` since 1970, with a zone or without."""
    return F.timestamp_millis(millis) if zone else F.timestamp_add("MILLISECOND", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
