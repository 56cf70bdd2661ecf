"""Wire grammars, the write-ahead log, sizes, settings, hashes and reports."""

import io
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomkv.functions.routing import fnv1a32, shard
from loomkv.operators import crypto
from loomkv.plans.config import EngineConfig
from loomkv.sources import report, wal, wire


@given(st.lists(st.tuples(st.sampled_from(["GET", "SET", "DEL"]), st.binary(max_size=20), st.binary(max_size=40), st.integers(-(2**40), 2**40)), max_size=6))
def test_frames_round_trip(commands):
    data = b"".join(wire.encode_frame(*c[:3], c[3]) for c in commands)
    assert [(op, key, value, ttl) for _, _, op, key, ttl, value, error in wire.decode_frames(data) if not error] == commands


@given(st.lists(st.tuples(st.sampled_from(["GET", "SET", "DEL"]), st.binary(max_size=20), st.binary(max_size=40)), max_size=5), st.binary(max_size=6), st.integers(1, 9))
def test_frames_from_a_slow_reader(commands, tail, step):
    data = b"".join(wire.encode_frame(*c) for c in commands) + tail

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, step))

    assert list(wire.read_frames(Slow(data))) == list(wire.decode_frames(data))


def test_frame_errors():
    error = lambda b: list(wire.decode_frames(b))[-1][-1]
    assert error(b"\0\0") == "short read" and error(b"\0\0\0\0") == "zero length" and error(b"\0\0\0\x05\x02") == "short read"
    assert error(b"\x7f\0\0\0") == "too long" and error(b"\0\0\0\x03\x02\x01\0") == "malformed"
    assert error(wire.encode_frame("SET", b"key")[:6] + b"\xff\xff" + bytes(11)) == "malformed"


@given(st.lists(st.binary(max_size=20), min_size=1, max_size=4))
def test_every_prefix_of_a_command_is_incomplete(args):
    data = b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%b\r\n" % (len(a), a) for a in args)
    assert wire.parse_resp(data) == (args, len(data))
    assert all(wire.parse_resp(data[:i]) is None for i in range(len(data)))


@pytest.mark.parametrize("data", [b"GET k\r\n", b"*x\r\n", b"*-1\r\n", b"*1\r\n:1\r\n", b"*1\r\n$-1\r\n", b"*1\r\n$1\r\nabc", b"*1\r\n$999999999\r\n"])
def test_malformed_commands(data):
    with pytest.raises(ValueError):
        wire.parse_resp(data)


def test_replies():
    assert [wire.reply("simple", "OK"), wire.reply("error", "ERR x"), wire.reply("int", 3), wire.reply("bulk", b"ab"), wire.reply("bulk")] == [b"+OK\r\n", b"-ERR x\r\n", b":3\r\n", b"$2\r\nab\r\n", b"$-1\r\n"]


def test_record_layout_and_torn_tail():
    one = wire.encode_record(b"testkey", b"testval", 1234567890)
    assert len(one) == 30 and one[:16].hex() == "0700000007000000d202964900000000"
    data = one + wire.encode_record(b"gone", None) + wire.encode_record(b"", b"")
    read = lambda b: list(wire.decode_records(io.BytesIO(b), len(b)))
    assert [x[1:] for x in read(data)] == [("SET", b"testkey", b"testval", 1234567890), ("DEL", b"gone", None, 0), ("SET", b"", b"", 0)]
    for cut in range(len(data)):
        whole = sum(cut >= end for end in (30, 50, 66))
        assert len(read(data[:cut])) == whole and wire.valid_offset(io.BytesIO(data[:cut]), cut) == [0, 30, 50, 66][whole]


def test_log_files(spark, tmp_path):
    rows = [(i % 3, i, "DEL" if i == 6 else "SET", f"k{i % 40}".encode(), b"" if i == 5 else f"v{i}".encode() * (1 + i % 5), 0) for i in range(100)]
    rows += [(0, 100, "SET", b"late", b"x", 50), (0, 101, "SET", b"k0", b"short", 60)]
    df = spark.createDataFrame(rows, "shard int, seq long, op string, key binary, value binary, expiry_ns long")
    wal.write_wal(df, str(tmp_path), 3)
    with open(tmp_path / "shard_001.db", "ab") as f:
        f.write(b"\1\0\0\0torn")
    back = wal.read_wal(spark, str(tmp_path))
    got = back.select("shard", "op", "key", "value", "expiry_ns", "valid_offset", "file_size").collect()
    assert len(got) == len(rows) and {r.file_size - r.valid_offset for r in got if r.shard == 1} == {8}
    assert sorted(map(tuple, got)) == sorted(map(tuple, wal.read_wal_store(spark, f"file://{tmp_path}").select("shard", "op", "key", "value", "expiry_ns", "valid_offset", "file_size").collect()))
    for now in (10, 60):
        want = {}
        for s, _, op, k, v, end in rows:
            if op == "DEL":
                want.pop((s, k), None)
            elif not end or end > now:
                want[(s, k)] = v
        assert {(r.shard, bytes(r.key)): bytes(r.value) for r in wal.replay_wal(back, now).collect()} == want
    assert wal.read_wal(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """An attempt that fails or isn't committed, or a job that fails, adds nothing; what was there stays."""
    folder = tmp_path / "wal"
    schema = "shard int, seq long, op string, key binary, value binary, expiry_ns long"
    good = spark.createDataFrame([(i % 2, i, "SET", f"k{i}".encode(), b"v", 0) for i in range(40)], schema)
    wal.write_wal(good, str(folder), 2)
    before = {p.name: p.read_bytes() for p in folder.iterdir()}

    class Row:
        def __init__(self, shard, key):
            self.shard, self.op, self.key, self.value, self.expiry_ns = shard, "SET", key, b"w", 0

    def broken():
        yield Row(0, b"half")
        raise OSError("disk")

    writer = wal.WalWriter(str(folder))
    with pytest.raises(OSError):
        writer.write(broken())
    again = [writer.write(iter([Row(0, b"x"), Row(1, b"y")])), writer.write(iter([Row(0, b"x"), Row(1, b"y")]))]
    assert {p.name: p.read_bytes() for p in folder.iterdir() if p.is_file()} == before
    writer.commit([again[1], None])  # the other attempt was a speculative one
    assert sorted(p.name for p in folder.iterdir()) == sorted(before)
    assert (folder / "shard_000.db").read_bytes() == before["shard_000.db"] + wal.encode_record(b"x", b"w")
    other = wal.WalWriter(str(folder))
    parts = other.write(iter([Row(0, b"z"), Row(1, b"z")]))
    now = {p.name: p.read_bytes() for p in folder.iterdir() if p.is_file()}
    parts.files[1] += "-lost"
    with pytest.raises(OSError):
        other.commit([parts])
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == now
    other = wal.WalWriter(str(folder))
    other.write(iter([Row(0, b"z")]))
    other.abort([])
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == now


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from loomkv.sources.folders import shared_dir

    kept = {}
    conf = SimpleNamespace(get=kept.get, set=kept.__setitem__)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
    assert shared_dir(session("local[2]")) == kept["spark.checkpoint.dir"] == shared_dir(session("yarn"))


def test_hash_and_shards(spark):
    known = {"": 2166136261, "a": 3826002220, "foobar": 3214735720, "mykey": 2981032458}
    rows = spark.createDataFrame([(k,) for k in known], "k string").select("k", fnv1a32(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in rows} == known
    for n in (16, 10, 7, 3):
        assert spark.range(3000).select(shard(F.concat(F.lit("key:"), F.col("id").cast("string")), n).alias("s")).distinct().count() == n


def test_encryption(spark):
    key, text = b"k" * 32, b"the quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(text,), (b"",)], "v binary").withColumn("e", crypto.encrypt(F.col("v"), key))
    for r in df.select("v", F.octet_length("e").alias("n"), crypto.decrypt(F.col("e"), key).alias("d"), crypto.decrypt(F.col("e"), b"x" * 32).alias("w"), crypto.decrypt(F.substring("e", 1, 20), key).alias("s")).collect():
        assert r.n == len(r.v) + 28 and r.d == r.v and r.w is None and r.s is None
    assert df.select(crypto.encrypt(F.col("v"), None).alias("p")).first().p == text
    with pytest.raises(ValueError):
        crypto.encrypt(F.col("v"), b"short")


def test_settings():
    c = EngineConfig.load({"shards": "4"}, {"LOOMKV_SHARDS": "9", "LOOMKV_MAX_MEM_BYTES": "4GiB", "LOOMKV_WHEEL_SLOTS": "64"})
    assert (c.shards, c.max_mem_bytes, c.wheel_slots, c.evict_interval_ms) == (4, 4 << 30, 64, 1000)
    assert EngineConfig.load({"encrypt": "true", "encryption_key": "k" * 32}, {"LOOMKV_EVICT": "0"}) == EngineConfig(encrypt=True, encryption_key="k" * 32, evict=False)
    for bad in ({"evict": "maybe"}, {"encrypt": "1"}, {"no_such": 1}, {"shards": "x"}, {"shards": "0"}, {"max_mem_bytes": "4 GiBs"}, {"encryption_key": "short"}, {"log_level": "loud"}):
        with pytest.raises(ValueError):
            EngineConfig.load(bad, {})


def test_reports(spark, tmp_path):
    part = lambda x: {"Ops/sec": x, "Hits/sec": 1.0, "Misses/sec": 2.0, "Average Latency": 0.5, "KB/sec": 9.0, "Percentile Latencies": {"p50.00": 0.1, "p99.00": 0.2, "p99.90": 0.3}, "More": [1]}
    for name, cpus, x in (("a", 4, 10.0), ("a", 16, 30.0), ("b", 4, 5.0)):
        (tmp_path / f"{name}_{cpus}c_bench.json").write_text(json.dumps({"configuration": {}, "ALL STATS": {"Sets": part(x), "Gets": part(2 * x), "Totals": part(3 * x)}}, indent=1))
    rows = report.read_reports(spark, f"file://{tmp_path}")
    assert rows.count() == 9 and rows.filter("kind = 'gets' AND cpus = 16").first().ops == 60.0
    table = report.by_cpus(rows.filter("kind = 'totals'"), "ops", [4, 16, 32])
    assert [tuple(r) for r in table.collect()] == [("a", 30.0, 90.0, 0.0), ("b", 15.0, 0.0, 0.0)]


def _blobs(spark, encode, broken):
    """Blobs of none, one and many commands, torn and broken ones, a null; some rows hold more than a batch does."""
    one = lambda i: encode(b"k%d" % i, b"v" * (i % 7))
    blobs = [b"", None, one(1), one(1) + one(2), one(3) + one(4)[:-1], one(5) + broken, b"".join(map(one, range(50)))] * 5
    return spark.createDataFrame([(i, f"n{i}", b) for i, b in enumerate(blobs)], "id long, name string, blob binary").coalesce(2)


@pytest.mark.parametrize("rows,size", [(10_000, 1 << 20), (7, 1 << 20), (10_000, 20)])
def test_frames_by_batches_are_those_of_the_table_function(spark, monkeypatch, rows, size):
    monkeypatch.setattr(wire, "BATCH_ROWS", rows)
    monkeypatch.setattr(wire, "BATCH_BYTES", size)
    df = _blobs(spark, lambda k, v: wire.encode_frame("SET", k, v, 5), b"\0\0\0\0")
    want = df.lateralJoin(wire.FrameTable(F.col("blob").outer())).drop("blob")
    got = wire.frames_of(df, "blob")
    assert got.dtypes == want.dtypes and "ArrowEvalPythonUDTF" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        wire.frames_of(df.withColumnRenamed("name", "key"), "blob")


@pytest.mark.parametrize("rows,size", [(10_000, 1 << 20), (7, 1 << 20), (10_000, 20)])
def test_commands_by_batches_are_those_of_the_table_function(spark, monkeypatch, rows, size):
    monkeypatch.setattr(wire, "BATCH_ROWS", rows)
    monkeypatch.setattr(wire, "BATCH_BYTES", size)
    bulk = lambda *args: b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%b\r\n" % (len(a), a) for a in args)
    df = _blobs(spark, lambda k, v: bulk(b"SET", k, v), b"GET k\r\n")
    want = df.lateralJoin(wire.RespTable(F.col("blob").outer())).drop("blob")
    got = wire.resp_of(df, "blob")
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["wire_roundtrip", "resp_session"])
def test_queries_decode_by_batches(spark, name):
    from loomkv.plans import queries as q

    plan = q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "UDTF" not in plan
