"""The command log: one row per command, totally ordered by ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("seq", "ts", "op", "key", "value", "ttl_ms", "expires_at")


def with_expiry(log: DataFrame) -> DataFrame:
    """``expires_at`` from a relative ttl; a ttl of zero or less means none."""
    return log.withColumn("expires_at", F.expr("CASE WHEN ttl_ms > 0 THEN timestampadd(MILLISECOND, ttl_ms, ts) END"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark.read.parquet(f"{sf_dir}/events.parquet"))


def commands(e: DataFrame) -> DataFrame:
    """Events, in a table or a stream, as commands."""
    is_set = F.col("event_type").isin("signup", "purchase")
    return with_expiry(
        e.select(
            F.col("event_id").alias("seq"),
            "ts",
            F.when(is_set, "SET").when(F.col("event_type") == "error", "DEL").otherwise("GET").alias("op"),
            F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
            F.when(is_set, F.col("props")).alias("value"),
            F.when(is_set, F.get_json_object("props", "$.k").cast("long") * 3_600_000).alias("ttl_ms"),
        )
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot-like log: an order sets its customer's entry, never expiring."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return with_expiry(
        o.select(
            F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"), F.lit("SET").alias("op"),
            F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("value"), F.lit(None).cast("long").alias("ttl_ms"),
        )
    )


EVENTS_SQL = """
log0 AS (SELECT event_id AS seq, ts,
  CASE WHEN event_type IN ('signup','purchase') THEN 'SET' WHEN event_type = 'error' THEN 'DEL' ELSE 'GET' END AS op,
  'user:' || user_id AS key, CASE WHEN event_type IN ('signup','purchase') THEN props END AS value,
  CASE WHEN event_type IN ('signup','purchase') THEN json_extract_string(props, '$.k')::BIGINT * 3600000 END AS ttl_ms FROM events),
log AS (SELECT *, CASE WHEN ttl_ms > 0 THEN ts + to_milliseconds(ttl_ms) END AS expires_at FROM log0)"""
