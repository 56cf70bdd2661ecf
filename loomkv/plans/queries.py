"""Registered queries of the command-log engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkv.functions import latency, replies
from loomkv.functions import text as T
from loomkv.functions.moments import epoch_micros
from loomkv.functions.routing import fnv1a32, shard
from loomkv.operators import asof, crypto, expiry, memory, state
from loomkv.plans.log import EVENTS_SQL, from_events, from_orders, with_expiry

AS_OF = "2024-01-20 00:00:00"
SHARDS = 8
KEY = b"0123456789abcdef0123456789abcdef"
WHEEL = {"interval_ms": 3_600_000, "slots": 64, "shards": SHARDS}

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


LOG = f"WITH {EVENTS_SQL}"
LATEST = f"""{LOG}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn
  FROM log WHERE op <> 'GET' AND ts <= TIMESTAMP '{AS_OF}') WHERE rn = 1),
live AS (SELECT * FROM latest WHERE op = 'SET' AND (expires_at IS NULL OR TIMESTAMP '{AS_OF}' <= expires_at))"""


def fnv_sql(key: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, len({key}) + 1), lambda i: ascii(substr({key}, i::INT, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


SHARD_SQL = f"({fnv_sql('key')} % {SHARDS})::INT"
# the state of every command: the last mutation before it
RESOLVED = f"""{LOG}, r AS (SELECT *, last_value(CASE WHEN op <> 'GET' THEN seq END IGNORE NULLS) OVER w AS pseq FROM log
  WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT r.*, m.op AS pop, m.value AS pvalue, m.expires_at AS pexp FROM r LEFT JOIN log m ON m.seq = r.pseq)"""


def counters_sql(probes: str) -> str:
    return f"""{RESOLVED}, c AS (SELECT *, op IN ({probes}) AS probe, coalesce(pop = 'SET', false) AS there FROM p),
l AS (SELECT *, probe AND there AND coalesce(ts > pexp, false) AS late FROM c),
g AS (SELECT *, min(CASE WHEN late THEN seq END) OVER (PARTITION BY key, pseq) AS gone FROM l)
SELECT {SHARD_SQL} AS shard, sum((probe AND there AND NOT late)::INT)::BIGINT AS hits,
  sum((probe AND (NOT there OR (late AND seq <> gone)))::INT)::BIGINT AS misses, sum((late AND seq = gone)::INT)::BIGINT AS expired_passive,
  sum(probe::INT + (op = 'SET')::INT + (op = 'DEL' AND there AND (gone IS NULL OR gone >= seq))::INT)::BIGINT AS total_commands
FROM g GROUP BY 1"""


@query(f"{LATEST} SELECT key, seq, value, expires_at FROM live")
def kv_live_state(spark, d):
    return state.live(from_events(spark, d), AS_OF)


@query(f"{LATEST} SELECT key, seq, op, value, expires_at FROM latest")
def kv_latest(spark, d):
    return state.latest(from_events(spark, d), AS_OF)


@query(f"{LATEST} SELECT key, seq, value, expires_at FROM latest WHERE op = 'SET' AND expires_at < TIMESTAMP '{AS_OF}'")
def kv_expired(spark, d):
    return state.expired(from_events(spark, d), AS_OF)


@query(f"{LATEST} SELECT key, seq FROM latest WHERE op = 'DEL'")
def kv_deleted(spark, d):
    return state.deleted(from_events(spark, d), AS_OF)


@query(f"""{LOG} SELECT key, seq, value, expires_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log
  WHERE op <> 'GET' AND ts <= TIMESTAMP '{AS_OF}' AND NOT (op = 'SET' AND coalesce(expires_at <= TIMESTAMP '{AS_OF}', false))) WHERE rn = 1 AND op = 'SET'""")
def kv_replay_compat(spark, d):
    return state.replay(from_events(spark, d), AS_OF)


#: Keys that are read one by one: live, deleted, expired and never set ones at each scale.
ASKED = [f"user:{i}" for i in range(0, 120)] + ["", "ghost"]
_ASKED_SQL = "asked AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in ASKED) + "]) AS asked)"


@query(f"{LATEST}, {_ASKED_SQL} SELECT asked AS key, key IS NOT NULL AS found, value FROM asked LEFT JOIN live ON key = asked")
def kv_get(spark, d):
    return state.get_many(from_events(spark, d), ASKED, AS_OF)


@query(f"""{LATEST}, {_ASKED_SQL} SELECT asked AS key, coalesce(strlen(value) <= 8, false) AS found, CASE WHEN strlen(value) <= 8 THEN value END AS value,
  key IS NOT NULL AS found_sealed, value AS value_sealed FROM asked LEFT JOIN live ON key = asked""")
def kv_get_into(spark, d):
    """A buffer of eight bytes over a plain store and over an encrypted one."""
    log = from_events(spark, d)
    sealed = state.get_many(log.withColumn("value", crypto.encrypt(F.col("value"), KEY)), ASKED, AS_OF, capacity=8, secret=KEY)
    return state.get_many(log, ASKED, AS_OF, capacity=8).join(sealed.select("key", F.col("found").alias("found_sealed"), F.col("value").alias("value_sealed")), "key")


@query(f"{LATEST} SELECT count(*) AS n_deleted FROM live WHERE key IN (SELECT 'user:' || c_custkey FROM customer)")
def kv_del_count(spark, d):
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return state.count_deleted(from_events(spark, d), asked, AS_OF)


@query("SELECT 'cust:' || o_custkey AS key, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS value, NULL::TIMESTAMP AS expires_at FROM orders GROUP BY 1")
def kv_orders_state(spark, d):
    return state.latest(from_orders(spark, d)).drop("op")


@query(f"{LOG} SELECT DISTINCT key, {fnv_sql('key')}::BIGINT AS hash, {SHARD_SQL} AS shard FROM log")
def fnv_hash(spark, d):
    return from_events(spark, d).select("key").distinct().select("key", fnv1a32(F.col("key")).alias("hash"), shard(F.col("key"), SHARDS).alias("shard"))


@query(f"{LOG} SELECT {SHARD_SQL} AS shard, count(*) AS n_commands, count(DISTINCT key) AS n_keys FROM log GROUP BY 1")
def shard_counts(spark, d):
    keys = from_events(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy(shard(F.col("key"), SHARDS).alias("shard")).agg(F.sum("n").alias("n_commands"), F.count(F.lit(1)).alias("n_keys"))


@query(f"{LOG}, s AS (SELECT {SHARD_SQL} AS shard, count(*) AS n FROM log GROUP BY 1) SELECT count(*) AS n_shards, max(n) AS largest, min(n) AS smallest, sum(n)::BIGINT AS total FROM s")
def shard_skew(spark, d):
    return shard_counts(spark, d).agg(F.count(F.lit(1)).alias("n_shards"), F.max("n_commands").alias("largest"), F.min("n_commands").alias("smallest"), F.sum("n_commands").alias("total"))


@query(f"{RESOLVED}, h AS (SELECT *, coalesce(pop = 'SET' AND (pexp IS NULL OR ts <= pexp), false) AS hit FROM p WHERE op = 'GET') SELECT seq, key, hit, CASE WHEN hit THEN pvalue END AS value FROM h")
def get_results(spark, d):
    return asof.get_results(from_events(spark, d))


@query(f"{RESOLVED} SELECT {SHARD_SQL} AS shard, sum(coalesce(pop = 'SET' AND (pexp IS NULL OR ts <= pexp), false)::INT)::BIGINT AS hits, count(*) AS gets FROM p WHERE op = 'GET' GROUP BY 1")
def hit_miss_by_shard(spark, d):
    return asof.per_shard(asof.get_results(from_events(spark, d)), SHARDS, hits=F.col("hit").cast("long"), gets=F.lit(1).cast("long"))


@query(counters_sql("'GET'"))
def counters_engine(spark, d):
    return asof.counters(from_events(spark, d), SHARDS)


@query(counters_sql("'GET', 'SET'"))
def counters_shard(spark, d):
    return asof.counters(from_events(spark, d), SHARDS, "shard")


@query(f"SELECT shard, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, sum(total_commands)::BIGINT AS total_commands FROM ({counters_sql(chr(39) + 'GET' + chr(39))}) GROUP BY ROLLUP (shard)")
def counters_rollup(spark, d):
    c = asof.counters(from_events(spark, d), SHARDS)
    return c.rollup("shard").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum("total_commands").alias("total_commands"))


GAUGES = f"{LATEST}, g AS (SELECT {SHARD_SQL} AS shard, count(*) AS key_count, sum(strlen(key) + strlen(value))::BIGINT AS allocated_bytes FROM latest WHERE op = 'SET' GROUP BY 1)"


@query(f"{GAUGES} SELECT * FROM g")
def gauges_by_shard(spark, d):
    s = state.latest(from_events(spark, d), AS_OF).filter("op = 'SET'").groupBy(shard(F.col("key"), SHARDS).alias("shard"))
    return s.agg(F.count(F.lit(1)).alias("key_count"), F.sum(F.octet_length("key") + F.octet_length("value")).alias("allocated_bytes"))


_METRICS = ["keys", "allocated_bytes", "hits", "misses", "expired_passive", "total_commands", "encrypted_bytes", "decrypted_bytes"]


@query()
def metrics_text(spark, d):
    """A line per shard and metric in the text form of metric scrapers."""
    g = gauges_by_shard(spark, d).withColumnRenamed("key_count", "keys")
    all_ = counters_engine(spark, d).join(g, "shard", "full").join(crypto_bytes(spark, d), "shard", "full")
    return all_.select(F.explode(F.array(*(F.format_string(f"shard_%d_{x} %d", "shard", F.coalesce(x, F.lit(0).cast("long"))) for x in _METRICS))).alias("line"))


DELTAS = f"""{LOG}, m AS (SELECT seq, key, op, CASE WHEN op = 'SET' THEN strlen(key) + strlen(value) ELSE 0 END AS size FROM log WHERE op <> 'GET'),
dl AS (SELECT seq, key, (size - coalesce(lag(size) OVER w, 0))::BIGINT AS delta, ((op = 'SET')::BIGINT - coalesce(lag(op) OVER w = 'SET', false)::BIGINT) AS key_delta FROM m WINDOW w AS (PARTITION BY key ORDER BY seq))"""


@query(f"{DELTAS} SELECT seq, delta, sum(delta) OVER (ORDER BY seq)::BIGINT AS allocated_bytes FROM dl")
def memory_timeline(spark, d):
    return memory.timeline(from_events(spark, d))


@query(f"{DELTAS} SELECT seq, key_delta, sum(key_delta) OVER (ORDER BY seq)::BIGINT AS key_count FROM dl")
def key_count_timeline(spark, d):
    return memory.running_total(memory.deltas(from_events(spark, d)), "key_delta", "seq", "key_count").select("seq", "key_delta", "key_count")


@query(f"""WITH RECURSIVE {EVENTS_SQL.lstrip()}, m AS (SELECT {SHARD_SQL} AS shard, seq, op, key, strlen(key) + coalesce(strlen(value), 0) AS size FROM log WHERE op <> 'GET'),
o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM m),
w AS (SELECT shard, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BOOLEAN AS accepted, 0::BIGINT AS held, MAP {{'': 0::BIGINT}} AS sizes FROM (SELECT DISTINCT shard FROM m)
  UNION ALL
  SELECT shard, rn, seq, fits, CASE WHEN fits THEN held + (CASE WHEN op = 'DEL' THEN 0 ELSE size END) - coalesce(sizes[key], 0) ELSE held END,
    CASE WHEN NOT fits THEN sizes WHEN op = 'DEL' THEN map_concat(sizes, MAP {{key: 0::BIGINT}}) ELSE map_concat(sizes, MAP {{key: size}}) END
  FROM (SELECT o.*, w.held, w.sizes, o.op = 'DEL' OR w.held + o.size <= {2400 // SHARDS} AS fits FROM w JOIN o ON o.shard = w.shard AND o.rn = w.rn + 1))
SELECT seq, shard, accepted, held AS allocated_bytes FROM w WHERE rn > 0""")
def memory_ceiling(spark, d):
    return memory.with_ceiling(from_events(spark, d), SHARDS, 2400)


STATEMENTS = [
    "SELECT * FROM kv WHERE key='{k}'", "insert into kv (key, value, ttl_ms) values ('{k}', 'v{n}', {n}000)", "  DELETE FROM kv WHERE key = \"{k}\" ",
    "SELECT * FROM kv", "DROP TABLE kv", "INSERT INTO kv VALUES ('{k}')", "INSERT INTO kv VALUES ('{k}','x', 86400001)", "select v where k >= {k}", "UPDATE kv SET v=1 WHERE key='{k}'", "INSERT INTO kv VALUES ('{k}','','-5')",
]


def _statements(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    forms = F.array(*map(F.lit, STATEMENTS))
    text = F.get(forms, (F.col("event_id") % len(STATEMENTS)).cast("int"))
    text = F.replace(F.replace(text, F.lit("{k}"), F.concat(F.lit("user:"), F.col("user_id").cast("string"))), F.lit("{n}"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("seq"), text.alias("text"))


_FORMS = ", ".join("'" + s.replace("'", "''") + "'" for s in STATEMENTS)
_TOKEN = "CASE WHEN trim({x}, chr(32)||chr(9)||chr(10)||chr(13)) IN ('', '''', '\"') THEN NULL WHEN regexp_matches(trim({x}), '^''.*''$') OR regexp_matches(trim({x}), '^\".*\"$') THEN substr(trim({x}), 2, len(trim({x})) - 2) ELSE trim({x}) END"
STATEMENTS_SQL = f"""WITH s AS (SELECT event_id AS seq, replace(replace(list_extract([{_FORMS}], (event_id % {len(STATEMENTS)})::INT + 1), '{{k}}', 'user:' || user_id), '{{n}}', user_id::VARCHAR) AS text FROM events),
a AS (SELECT seq, text, lower(trim(text)) AS low, trim(text) AS t FROM s),
b AS (SELECT *, CASE WHEN low LIKE 'select%' THEN 'GET' WHEN low LIKE 'insert%' THEN 'SET' WHEN low LIKE 'delete%' THEN 'DELETE' END AS o,
  CASE WHEN instr(low, 'where') > 0 AND instr(substr(t, instr(low, 'where') + 5), '=') > 0 THEN substr(substr(t, instr(low, 'where') + 5), instr(substr(t, instr(low, 'where') + 5), '=') + 1) END AS wk,
  CASE WHEN instr(low, 'values') > 0 THEN string_split(regexp_extract(substr(t, instr(low, 'values') + 6), '^[^(]*\\(([^)]*)\\)', 1), ',') END AS part FROM a),
c AS (SELECT seq, o, {_TOKEN.format(x="CASE WHEN o = 'SET' THEN part[1] ELSE wk END")} AS k, {_TOKEN.format(x='part[2]')} AS v, {_TOKEN.format(x='part[3]')} AS tt FROM b),
e AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(coalesce(tt, ''), '^[0-9]+'), '') AS BIGINT), 0) AS n, o IS NULL OR k IS NULL OR (o = 'SET' AND v IS NULL) AS bad FROM c),
f AS (SELECT *, NOT bad AND NOT (o = 'SET' AND n > 86400000) AS ok FROM e)
SELECT seq, CASE WHEN NOT bad THEN o END AS op, CASE WHEN ok THEN k END AS key, CASE WHEN ok AND o = 'SET' THEN v END AS value, CASE WHEN ok AND o = 'SET' THEN n END AS ttl_ms,
  CASE WHEN bad THEN 'parse error' WHEN NOT ok THEN 'ttl overflow' END AS error FROM f"""


@query(STATEMENTS_SQL)
def sql_parse(spark, d):
    return _statements(spark, d).withColumn("p", T.parse_sql(F.col("text"))).select("seq", "p.*")


def _arguments(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    pick = lambda xs, by: F.get(F.array(*map(F.lit, xs)), (by % len(xs)).cast("int"))
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(i.alias("seq"), pick(["GET", "set", "Del", "PING", "command", "FLUSH"], i).alias("name"), (i % 5 + 1).cast("int").alias("n_args"), pick(["EX", "px", "NX"], u).alias("option"), pick(["10", "-1", "abc", "0", "250"], i).alias("amount"))


_ARGS_SQL = """WITH a AS (SELECT event_id AS seq, list_extract(['GET','set','Del','PING','command','FLUSH'], (event_id % 6)::INT + 1) AS name, (event_id % 5 + 1)::INT AS n_args,
  list_extract(['EX','px','NX'], (user_id % 3)::INT + 1) AS option, list_extract(['10','-1','abc','0','250'], (event_id % 5)::INT + 1) AS amount FROM events)"""


@query(f"""{_ARGS_SQL}, b AS (SELECT *, try_cast(amount AS BIGINT) AS n FROM a WHERE n_args IN (3, 5)),
c AS (SELECT *, n_args = 5 AND upper(option) IN ('EX','PX') AND coalesce(n >= 0, false) AS fine FROM b)
SELECT seq, CASE WHEN n_args = 3 THEN 0 WHEN fine THEN CASE WHEN upper(option) = 'EX' THEN n * 1000 ELSE n END END::BIGINT AS ttl_ms, CASE WHEN NOT (n_args = 3 OR fine) THEN 'ERR syntax error' END AS error FROM c""")
def resp_set_options(spark, d):
    return _arguments(spark, d).filter("n_args IN (3, 5)").withColumn("p", T.set_ttl(F.col("n_args"), F.col("option"), F.col("amount"))).select("seq", "p.*")


@query(f"""{_ARGS_SQL} SELECT seq, CASE WHEN upper(name) NOT IN ('GET','SET','DEL','PING','COMMAND') THEN 'ERR unknown command ''' || name || ''''
  WHEN (upper(name) = 'GET' AND n_args <> 2) OR (upper(name) = 'SET' AND n_args NOT IN (3, 5)) OR (upper(name) = 'DEL' AND n_args < 2) THEN 'ERR wrong number of arguments for ''' || lower(name) || ''' command' END AS error FROM a""")
def command_errors(spark, d):
    return _arguments(spark, d).select("seq", T.command_error(F.col("name"), F.col("n_args")).alias("error"))


_SIZES = ["16MiB", "1GiB", "256KB", "0", "123", "4GiB", "7kib", "x", "1.5MB", ""]


@query("SELECT * FROM (VALUES ('16MiB', 16777216::BIGINT), ('1GiB', 1073741824), ('256KB', 256000), ('0', 0), ('123', 123), ('4GiB', 4294967296), ('7kib', 7168), ('x', NULL), ('1.5MB', NULL), ('', NULL)) t(text, n_bytes)")
def bytesize_parse(spark, d):
    return spark.createDataFrame([(x,) for x in _SIZES], "text string").select("text", T.byte_size(F.col("text")).alias("n_bytes"))


@query("""SELECT o_orderkey AS id, CASE WHEN n = 0 THEN '16 MiB' WHEN n >= 1073741824 AND n % 1073741824 = 0 THEN (n // 1073741824) || ' GiB' WHEN n >= 1048576 AND n % 1048576 = 0 THEN (n // 1048576) || ' MiB'
  WHEN n >= 1024 AND n % 1024 = 0 THEN (n // 1024) || ' KiB' ELSE n::VARCHAR END AS text FROM (SELECT o_orderkey, (o_orderkey % 5) * CASE o_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS n FROM orders)""")
def bytesize_format(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    n = (F.col("o_orderkey") % 5) * F.element_at(F.array(*(F.lit(x).cast("long") for x in (1, 1024, 1 << 20, 1 << 30))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), T.format_byte_size(n).alias("text"))


@query(f"""{RESOLVED} SELECT seq, CASE WHEN op = 'GET' THEN CASE WHEN coalesce(pop = 'SET' AND (pexp IS NULL OR ts <= pexp), false) THEN pvalue ELSE 'ERR NOT_FOUND' END ELSE 'OK' END AS response FROM p""")
def binary_responses(spark, d):
    return asof.with_previous(from_events(spark, d)).select("seq", T.binary_response(F.col("op"), asof.live_before(), F.col("prev.value")).alias("response"))


REG = f"""{LOG}, reg AS (SELECT *, {SHARD_SQL} AS shard, epoch_ms(ts) // 3600000 AS tick, least(ttl_ms // 3600000, 63)::BIGINT AS steps FROM log WHERE op = 'SET' AND ttl_ms > 0),
reg2 AS (SELECT *, ((tick + steps) % 64)::INT AS slot, tick + steps + 1 AS fire_tick FROM reg),
reg3 AS (SELECT *, row_number() OVER (PARTITION BY shard, fire_tick ORDER BY seq) AS rank FROM reg2)"""


@query(f"{REG} SELECT seq, shard, steps, slot FROM reg3")
def wheel_slots(spark, d):
    return expiry.registrations(from_events(spark, d), **WHEEL).select("seq", "shard", "steps", "slot")


@query(f"{REG} SELECT shard, fire_tick, count(*) AS n_dropped FROM reg3 WHERE rank > 2 GROUP BY 1, 2")
def wheel_overflow(spark, d):
    r = expiry.registrations(from_events(spark, d), **WHEEL, capacity=2).filter("overflow")
    return r.groupBy("shard", "fire_tick").agg(F.count(F.lit(1)).alias("n_dropped"))


WHEEL_EVENTS = f"""{REG}, ev AS (SELECT ts, 0 AS kind, seq, op, key, value, expires_at, NULL::BIGINT AS fire_tick FROM log
  UNION ALL SELECT make_timestamp(fire_tick * 3600000000), 1, seq, 'FIRE', key, NULL, NULL, fire_tick FROM reg3 WHERE rank <= 512),
no AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, kind, seq) AS n FROM ev),
pr AS (SELECT *, last_value(CASE WHEN op IN ('SET', 'DEL') THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pseq FROM no),
lt AS (SELECT pr.*, coalesce(m.op = 'SET', false) AS there, pr.op IN ('GET', 'FIRE') AND coalesce(m.op = 'SET' AND pr.ts > m.expires_at, false) AS late FROM pr LEFT JOIN log m ON m.seq = pr.pseq),
gn AS (SELECT *, min(CASE WHEN late THEN n END) OVER (PARTITION BY key, pseq) AS gone FROM lt)"""


@query(f"""{WHEEL_EVENTS} SELECT seq, key, fire_tick, CASE WHEN late AND n = gone THEN 'evict' WHEN NOT there OR late OR gone < n THEN 'gone' WHEN pseq = seq THEN 'early' ELSE 'stale' END AS outcome
FROM gn WHERE op = 'FIRE'""")
def wheel_outcomes(spark, d):
    return expiry.fired(from_events(spark, d), **WHEEL)


@query(f"""{WHEEL_EVENTS} SELECT {SHARD_SQL} AS shard, sum((op = 'GET' AND there AND NOT late)::INT)::BIGINT AS hits, sum((op = 'GET' AND (NOT there OR (late AND n <> gone)))::INT)::BIGINT AS misses,
  sum((op = 'GET' AND late AND n = gone)::INT)::BIGINT AS expired_passive, sum((op = 'FIRE' AND late AND n = gone)::INT)::BIGINT AS evicted, sum((op = 'FIRE')::INT)::BIGINT AS popped,
  sum((op IN ('GET', 'SET'))::INT + (op = 'DEL' AND there AND (gone IS NULL OR gone >= n))::INT + (op = 'FIRE' AND late AND n = gone)::INT)::BIGINT AS total_commands FROM gn GROUP BY 1""")
def counters_evicting(spark, d):
    return expiry.counters_evicting(from_events(spark, d), **WHEEL)


_BUCKET = "CASE WHEN u < 100 THEN u WHEN u < 1000 THEN 100 + (u - 100) // 10 WHEN u < 10000 THEN 190 + (u - 1000) // 100 WHEN u < 100000 THEN 280 + (u - 10000) // 1000 ELSE 370 END"
_HIST = f"WITH h AS (SELECT ({_BUCKET})::INT AS bucket, count(*) AS n FROM (SELECT greatest(floor(value * 100)::BIGINT, 0) AS u FROM events) GROUP BY 1)"


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("worker"), (F.col("value") * 100).alias("us"))


@query(f"{_HIST} SELECT bucket, n FROM h")
def latency_buckets(spark, d):
    return latency.histogram(_latencies(spark, d), "us")


_LOW = "CASE WHEN b < 100 THEN b WHEN b < 190 THEN (b - 90) * 10 WHEN b < 280 THEN (b - 180) * 100 WHEN b < 370 THEN (b - 270) * 1000 ELSE 100000 END"


@query(f"{_HIST}, c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS cum, sum(n) OVER () AS total FROM h), x AS (SELECT p, min(bucket) AS b FROM c, (VALUES (0.5::DOUBLE), (0.9), (0.99), (0.999)) v(p) WHERE cum >= floor(total * p) GROUP BY p) SELECT p, ({_LOW})::BIGINT AS us FROM x")
def latency_percentiles(spark, d):
    return latency.percentiles(latency.histogram(_latencies(spark, d), "us"), [0.5, 0.9, 0.99, 0.999])


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_exact(spark, d):
    p = latency.exact_percentiles(spark.read.parquet(f"{d}/events.parquet"), "value", [0.5, 0.99])
    return p.select(F.col("p0").alias("p50"), F.col("p1").alias("p99"))


@query("SELECT count(*) AS n_commands, date_diff('second', min(ts), max(ts)) AS seconds, (count(*) * 1000 // date_diff('second', min(ts), max(ts)))::BIGINT AS per_1000_s FROM events")
def throughput(spark, d):
    log = from_events(spark, d)
    s = F.floor(epoch_micros(log, "ts") / 1_000_000)
    s = F.max(s) - F.min(s)
    return log.agg(F.count(F.lit(1)).alias("n_commands"), s.alias("seconds")).withColumn("per_1000_s", F.floor(F.expr("n_commands * 1000 div seconds")))


@query("SELECT event_type, sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS c0, sum(CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END)::DOUBLE AS c1, sum(CASE WHEN user_id % 3 = 2 THEN 1 ELSE 0 END)::DOUBLE AS c2 FROM events GROUP BY 1")
def report_pivot(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("c"))
    return e.groupBy("event_type").pivot("c", ["c0", "c1", "c2"]).agg(F.count(F.lit(1)).cast("double")).na.fill(0.0)


@query(f"{LOG} SELECT seq, value AS decrypted, (strlen(value) + 28)::INT AS stored_length, true AS wrong_key_is_miss FROM log WHERE op = 'SET'")
def crypto_roundtrip(spark, d):
    s = from_events(spark, d).filter("op = 'SET'").withColumn("sealed", crypto.encrypt(F.col("value"), KEY))
    return s.select("seq", crypto.decrypt(F.col("sealed"), KEY).cast("string").alias("decrypted"), F.octet_length("sealed").alias("stored_length"), crypto.decrypt(F.col("sealed"), KEY[::-1]).isNull().alias("wrong_key_is_miss"))


@query(f"{RESOLVED} SELECT {SHARD_SQL} AS shard, sum(CASE WHEN op = 'SET' THEN strlen(value) + 28 ELSE 0 END)::BIGINT AS encrypted_bytes, sum(CASE WHEN op = 'GET' AND coalesce(pop = 'SET' AND (pexp IS NULL OR ts <= pexp), false) THEN strlen(pvalue) ELSE 0 END)::BIGINT AS decrypted_bytes FROM p GROUP BY 1")
def crypto_bytes(spark, d):
    rows, hit = asof.with_previous(from_events(spark, d)), asof.live_before() & (F.col("op") == "GET")
    return asof.per_shard(
        rows, SHARDS,
        encrypted_bytes=F.when(F.col("op") == "SET", crypto.stored_length(F.col("value"), KEY)).otherwise(0).cast("long"),
        decrypted_bytes=F.when(hit, F.octet_length("prev.value")).otherwise(0).cast("long"),
    )


@query(f"{LOG} SELECT ((seq % 16) % 8)::INT AS shard, count(DISTINCT seq % 16) AS connections, sum(16 + strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes_read FROM log GROUP BY 1")
def connection_bytes(spark, d):
    """Sixteen made-up connections; a connection belongs to shards in turn, whatever its keys."""
    rows = from_events(spark, d).withColumn("conn", F.col("seq") % 16)
    size = F.lit(16) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return rows.groupBy((F.col("conn") % 8).cast("int").alias("shard")).agg(F.countDistinct("conn").alias("connections"), F.sum(size).alias("bytes_read"))


_MOMENTS = ["2024-01-05 00:00:00", "2024-01-15 00:00:00", "2024-01-25 00:00:00"]


@query(f"""{LOG}, v AS (SELECT unnest([{', '.join(f"TIMESTAMP '{x}'" for x in _MOMENTS)}]) AS as_of),
l AS (SELECT as_of, log.*, row_number() OVER (PARTITION BY as_of, key ORDER BY seq DESC) AS rn FROM log JOIN v ON ts <= as_of WHERE op <> 'GET')
SELECT as_of, key, value FROM l WHERE rn = 1 AND op = 'SET' AND (expires_at IS NULL OR as_of <= expires_at)""")
def state_at_moments(spark, d):
    """Extension: states at several moments in one pass, each mutation going to the moments after it."""
    log = from_events(spark, d).filter("op <> 'GET'")
    moments = F.filter(F.array(*(state.moment(x) for x in _MOMENTS)), lambda m: m >= F.col("ts"))
    last = log.withColumn("as_of", F.explode(moments)).groupBy("as_of", "key").agg(F.max_by(F.struct("op", "value", "expires_at"), "seq").alias("m"))
    return last.filter("m.op = 'SET' AND (m.expires_at IS NULL OR as_of <= m.expires_at)").select("as_of", "key", "m.value")


@query(f"{LOG}, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE op <> 'GET') SELECT key, seq, value, expires_at FROM c WHERE rn = 1 AND op = 'SET'")
def log_compaction(spark, d):
    return state.compact(from_events(spark, d)).select("key", "seq", "value", "expires_at")


@query(f"{LATEST} SELECT key, value FROM live WHERE key LIKE 'user:1%'")
def key_like_scan(spark, d):
    return state.live(from_events(spark, d).filter("key LIKE 'user:1%'"), AS_OF).select("key", "value")


@query(f"{LOG} SELECT date_trunc('hour', ts) AS hour, op, count(*) AS n FROM log GROUP BY 1, 2")
def op_rates(spark, d):
    return from_events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "op").agg(F.count(F.lit(1)).alias("n"))


@query(f"{LOG} SELECT {SHARD_SQL} AS shard, round(quantile_cont(ttl_ms, 0.5))::BIGINT AS median_ttl_ms, max(ttl_ms)::BIGINT AS max_ttl_ms FROM log WHERE op = 'SET' GROUP BY 1")
def ttl_by_shard(spark, d):
    s = from_events(spark, d).filter("op = 'SET'").groupBy(shard(F.col("key"), SHARDS).alias("shard"))
    return s.agg(F.round(F.percentile("ttl_ms", 0.5)).cast("long").alias("median_ttl_ms"), F.max("ttl_ms").alias("max_ttl_ms"))


@query("SELECT c_custkey AS id, lower(c_mktsegment) = 'building' AS folds, trim('  ' || c_mktsegment || chr(9), ' ' || chr(9)) AS trimmed, strlen(c_name)::INT AS n_bytes FROM customer")
def text_functions(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    padded = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("\t"))
    return c.select(F.col("c_custkey").alias("id"), (F.lower("c_mktsegment") == F.lower(F.lit("BuilDing"))).alias("folds"), T.token(padded).alias("trimmed"), F.octet_length("c_name").alias("n_bytes"))


@query(f"""{RESOLVED}, h AS (SELECT *, coalesce(pop = 'SET' AND (pexp IS NULL OR ts <= pexp), false) AS hit FROM p)
SELECT seq, CASE op WHEN 'SET' THEN '+OK' WHEN 'DEL' THEN ':' || hit::INT WHEN 'GET' THEN CASE WHEN hit THEN '$' || strlen(pvalue) || chr(13) || chr(10) || pvalue ELSE '$-1' END END || chr(13) || chr(10) AS reply FROM h""")
def resp_replies(spark, d):
    return asof.with_previous(from_events(spark, d)).select("seq", replies.reply(F.col("op"), asof.live_before(), F.col("prev.value")).alias("reply"))


@query(f"""{_ARGS_SQL}, e AS (SELECT *, CASE WHEN upper(name) NOT IN ('GET','SET','DEL','PING','COMMAND') THEN 'ERR unknown command ''' || name || ''''
  WHEN (upper(name) = 'GET' AND n_args <> 2) OR (upper(name) = 'SET' AND n_args NOT IN (3, 5)) OR (upper(name) = 'DEL' AND n_args < 2) THEN 'ERR wrong number of arguments for ''' || lower(name) || ''' command' END AS bad FROM a)
SELECT seq, CASE WHEN bad IS NOT NULL THEN '-' || bad || chr(13) || chr(10) WHEN upper(name) = 'PING' THEN CASE WHEN n_args > 1 THEN '$' || strlen(amount) || chr(13) || chr(10) || amount || chr(13) || chr(10) ELSE '+PONG' || chr(13) || chr(10) END
  WHEN upper(name) = 'COMMAND' THEN '*0' || chr(13) || chr(10) END AS reply FROM e""")
def keyless_replies(spark, d):
    return _arguments(spark, d).select("seq", replies.keyless(F.col("name"), F.col("n_args"), F.col("amount")).alias("reply"))


#: The stream gets the events in so many parts of a month; one row in seven comes a part late.
STREAM_PARTS, STREAM_DAYS, STREAM_DELAY = 4, 8, "9 days"
_PART = f"least(date_diff('day', DATE '2024-01-01', ts::DATE) // {STREAM_DAYS} + (event_id % 7 = 3)::INT, {STREAM_PARTS - 1})"


@query(f"""WITH {EVENTS_SQL.lstrip()}, b AS (SELECT event_id AS seq, {_PART} AS b FROM events),
late AS (SELECT b, epoch_ms(max(ts)) - 9 * 86400000 AS wm FROM b JOIN log USING (seq) GROUP BY 1),
wm AS (SELECT b, max(wm) OVER (ORDER BY b) AS wm FROM late),
last AS (SELECT b, key, max(seq) AS seq FROM log JOIN b USING (seq) WHERE op <> 'GET' GROUP BY ALL),
best AS (SELECT *, max(seq) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM last),
ch AS (SELECT *, lead(b) OVER (PARTITION BY key ORDER BY b) AS next FROM best WHERE before IS NULL OR seq > before),
e AS (SELECT ch.key, ch.seq, op, value, expires_at, coalesce(next - 1, {STREAM_PARTS - 1}) AS upto FROM ch JOIN log USING (seq))
SELECT key, seq, op, value FROM e
UNION ALL SELECT key, seq, 'EXPIRED', value FROM e JOIN wm ON wm.b = upto WHERE op = 'SET' AND epoch_ms(expires_at) < wm.wm""")
def stream_state(spark, d):
    """Every change that the streamed state gives out, expiries too, over restarts and rows out of order."""
    from loomkv.streaming.state import run_parts

    e = spark.read.parquet(f"{d}/events.parquet")
    part = F.least(F.expr(f"datediff(ts, DATE '2024-01-01') div {STREAM_DAYS}") + (F.col("event_id") % 7 == 3).cast("int"), F.lit(STREAM_PARTS - 1))
    return run_parts(spark, [e.filter(part == i) for i in range(STREAM_PARTS)], STREAM_DELAY).select("key", "seq", "op", "value")


@query(f"SELECT seq, 'key-' || (floor(u * sqrt(u) * 50000)::BIGINT % 50000) AS key FROM (SELECT event_id AS seq, {fnv_sql('key')} / 4294967296.0::DOUBLE AS u FROM (SELECT event_id, 'row:' || (event_id * 2654435761 % 4294967296) AS key FROM events))")
def workload_keys(spark, d):
    """Keys drawn with a power law of exponent 1.5, from hashes of row numbers in place of a random stream."""
    n = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"))
    u = fnv1a32(F.concat(F.lit("row:"), (F.col("seq") * 2654435761 % (1 << 32)).cast("string"))) / float(1 << 32)
    return n.withColumn("u", u).select("seq", F.concat(F.lit("key-"), (F.floor(F.col("u") * F.sqrt("u") * 50_000) % 50_000).cast("string")).alias("key"))


def _resp_frames(spark: SparkSession, d: str) -> DataFrame:
    """(seq, ts, frame): each command as a RESP array; a SET with a ttl carries EX where whole seconds do, else PX."""
    bulk = lambda x: F.concat(F.lit("$"), F.octet_length(x).cast("string"), F.lit("\r\n"), x, F.lit("\r\n"))
    seconds = (F.col("ttl_ms") % 1000 == 0) & (F.col("seq") % 2 == 0)
    option = F.array(F.when(seconds, "EX").otherwise("px"), F.when(seconds, F.expr("ttl_ms div 1000")).otherwise(F.col("ttl_ms")).cast("string"))
    more = F.when(F.col("op") != "SET", F.array().cast("array<string>")).when(F.col("ttl_ms").isNull(), F.array("value")).otherwise(F.concat(F.array("value"), option))
    args = F.concat(F.array("op", "key"), more)
    frame = F.concat(F.lit("*"), F.size(args).cast("string"), F.lit("\r\n"), F.array_join(F.transform(args, bulk), ""))
    return from_events(spark, d).select("seq", "ts", frame.cast("binary").alias("frame"))


def _resp_commands(spark: SparkSession, d: str) -> DataFrame:
    """The log again, from the bytes: parsed arguments, then the options of SET."""
    from loomkv.sources.wire import resp_of

    at = lambda i: F.get("args", F.lit(i)).cast("string")
    rows = resp_of(_resp_frames(spark, d), "frame").select("seq", "ts", F.upper(at(0)).alias("op"), at(1).alias("key"), at(2).alias("value"), T.set_ttl(F.size("args"), at(3), at(4)).alias("o"))
    return with_expiry(rows.select("seq", "ts", "op", "key", "value", F.when(F.col("op") == "SET", F.col("o.ttl_ms")).alias("ttl_ms")))


@query(f"{LOG} SELECT seq, op, key, value, ttl_ms FROM log")
def wire_roundtrip(spark, d):
    """Commands as RESP arrays, SETs with their options, parsed back from the bytes."""
    return _resp_commands(spark, d).select("seq", "op", "key", "value", "ttl_ms")


@query(_SQL["resp_replies"])
def resp_session(spark, d):
    """From bytes to bytes: RESP arrays are parsed, run against the state and answered."""
    return asof.with_previous(_resp_commands(spark, d)).select("seq", replies.reply(F.col("op"), asof.live_before(), F.col("prev.value")).alias("reply"))


@query(f"{LOG} SELECT seq, 2::INT AS kind, op, key, coalesce(ttl_ms, 0) AS ttl_ms, coalesce(value, '') AS value FROM log")
def frame_roundtrip(spark, d):
    """Commands as binary frames made by expressions, decoded from the bytes."""
    from loomkv.sources.wire import frames_of

    number = lambda n, width: F.unhex(F.lpad(F.hex(n), 2 * width, "0"))
    key, value = F.col("key").cast("binary"), F.coalesce("value", F.lit("")).cast("binary")
    code = F.when(F.col("op") == "GET", 1).when(F.col("op") == "SET", 2).otherwise(3)
    body = F.concat(number(F.lit(2), 1), number(code, 1), number(F.octet_length("key"), 2), number(F.coalesce("ttl_ms", F.lit(0)), 8), key, value)
    rows = from_events(spark, d).withColumn("body", body)
    frames = rows.select("seq", F.concat(number(F.octet_length("body"), 4), F.col("body")).alias("frame"))
    return frames_of(frames, "frame").select("seq", "kind", "op", F.col("key").cast("string").alias("key"), "ttl_ms", F.col("value").cast("string").alias("value"))


_SQL["metrics_text"] = f"""WITH g AS ({_SQL["gauges_by_shard"]}), c AS ({_SQL["counters_engine"]}), x AS ({_SQL["crypto_bytes"]}),
j AS (SELECT coalesce(g.shard, c.shard, x.shard) AS shard, key_count AS keys, allocated_bytes, hits, misses, expired_passive, total_commands, encrypted_bytes, decrypted_bytes
  FROM c FULL JOIN g ON g.shard = c.shard FULL JOIN x ON x.shard = coalesce(c.shard, g.shard))
{" UNION ALL ".join(f"SELECT 'shard_' || shard || '_{x} ' || coalesce({x}, 0) AS line FROM j" for x in _METRICS)}"""
