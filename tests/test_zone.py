"""Results that must not depend on the session's time zone."""

import duckdb
import pytest

from loomkv.plans import queries as q

SF = "/root/testdata/sf0.001"
NAMES = ["wheel_outcomes", "wheel_overflow", "wheel_slots"]


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kathmandu"])
@pytest.mark.parametrize("name", NAMES)
def test_query_in_another_zone(spark, name, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = q.queries()[name](spark, SF)
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert rows == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({q.oracle_sql()[name]})").fetchall())
