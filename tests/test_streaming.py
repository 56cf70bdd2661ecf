"""The streamed state over several batches: changes, late timers, parity with the batch query."""

import datetime as dt

import pytest

from loomkv.operators import state
from loomkv.plans.log import with_expiry
from loomkv.streaming.state import op_rates, stream_state

T0 = dt.datetime(2024, 1, 1)
LOG = "seq long, ts timestamp_ntz, op string, key string, value string, ttl_ms long"


@pytest.fixture
def log_files(spark, tmp_path):
    """Two files, read one by one."""
    rows = [
        [(0, 0, "SET", "a", "1", 10), (1, 1, "SET", "b", "1", 0), (2, 2, "SET", "a", "2", 20), (3, 3, "GET", "a", None, None), (4, 4, "SET", "d", "x", 5000)],
        [(5, 1000, "DEL", "b", None, None), (6, 1001, "SET", "c", "1", 0), (7, 1002, "SET", "d", "y", 0), (8, 1003, "GET", "z", None, None)],
    ]
    for i, part in enumerate(rows):
        data = [(s, T0 + dt.timedelta(milliseconds=ms), op, k, v, ttl) for s, ms, op, k, v, ttl in part]
        spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log/part={i}")
    schema = spark.read.parquet(f"file://{tmp_path}/log").drop("part").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log/part=*")
    return with_expiry(stream), with_expiry(spark.read.parquet(f"file://{tmp_path}/log"))


def collect(spark, df, name, mode, folder):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(provider, before)
    return spark.table(name).collect()


def test_changes_and_timers(spark, log_files, tmp_path):
    stream, batch = log_files
    got = collect(spark, stream_state(stream), "changes", "update", f"file://{tmp_path}/c1")
    seen = {(r.key, r.seq, r.op) for r in got}
    assert {("b", 1, "SET"), ("a", 2, "SET"), ("b", 5, "DEL"), ("c", 6, "SET"), ("d", 7, "SET")} <= seen
    assert [(r.key, r.seq) for r in got if r.op == "EXPIRED"] == [("a", 2)]  # the timer of the first a was stale, d lives on
    last = {}
    for r in sorted(got, key=lambda r: (r.seq, r.op == "EXPIRED")):
        last[r.key] = None if r.op in ("DEL", "EXPIRED") else r.value
    now = {r.key: r.value for r in state.live(batch, str(T0 + dt.timedelta(seconds=2))).collect()}
    assert {k: v for k, v in last.items() if v is not None} == now == {"c": "1", "d": "y"}


def test_order_of_arrival(spark, tmp_path):
    """Within the delay an older SET that comes after its deletion changes nothing, in three batches; beyond it rows are dropped."""
    from loomkv.plans.log import with_expiry
    from loomkv.streaming.state import run_available

    batches = [
        [(1, 0, "SET", "a", "old", 0), (5, 500, "DEL", "a", None, None), (2, 100, "SET", "b", "1", 300)],
        [(3, 200, "SET", "a", "late", 0), (4, 300, "SET", "c", "1", 0), (6, 600, "SET", "d", "1", 0)],
        [(0, 50, "SET", "c", "older", 0), (8, 2000, "SET", "e", "1", 0)],
        [(7, 700, "SET", "f", "too late", 0), (9, 2500, "GET", "f", None, None)],
    ]
    schema = spark.createDataFrame([], LOG).schema
    for rows in batches:
        data = [(s, T0 + dt.timedelta(milliseconds=ms), op, k, v, ttl) for s, ms, op, k, v, ttl in rows]
        spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = with_expiry(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
        run_available(spark, stream_state(stream, "1 second"), f"file://{tmp_path}/c", f"file://{tmp_path}/out")
    got = {(r.key, r.seq, r.op) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {("a", 5, "DEL"), ("b", 2, "SET"), ("b", 2, "EXPIRED"), ("c", 4, "SET"), ("d", 6, "SET"), ("e", 8, "SET")}


def test_rates(spark, log_files, tmp_path):
    stream, batch = log_files
    want = {(r.window.start, r.op): r.n for r in op_rates(batch, "1 second", "0 seconds").collect()}
    got = collect(spark, op_rates(stream, "1 second", "0 seconds"), "rates", "complete", f"file://{tmp_path}/c2")
    assert {(r.window.start, r.op): r.n for r in got} == want and sum(want.values()) == 9


@pytest.mark.parametrize("buckets", [1, 3])
def test_keys_of_a_bucket_share_a_call(spark, monkeypatch, buckets):
    """The query of the streamed state against its SQL with all keys in one bucket, or in few."""
    import duckdb

    from loomkv.plans import queries as q
    from loomkv.streaming import state as streamed

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(streamed, "BUCKETS", buckets)
    got = q.queries()["stream_state"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({q.oracle_sql()['stream_state']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
