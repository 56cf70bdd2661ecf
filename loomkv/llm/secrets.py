"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Base spans come from three patterns.  Besides these, long mixed tokens are candidates; a hash of every candidate
is aggregated over the whole corpus by distinct repositories (``source``) and owners (the part of ``source``
before a slash, else all of it).  A token seen with more than ``COPIED_OWNERS`` owners is a widely copied example;
one tied to few owners looks live and becomes a span of kind ``owned``.  Base spans always stay; the same counts
mark them as live or copied.

Defined results: null and empty texts have no spans; offsets are code points; a null source is an owner of its
own; repeated rows are scanned each for itself; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkv.llm.common import broadcast_if, materialise, size_of, table

COPIED_OWNERS = 3
#: Measured bytes up to which copied secrets or a table of spans are broadcast.
BROADCAST_BYTES = 8 << 20
#: Copied secrets with over this share of all spans are broadcast in any case: at most as many as its inverse.
HOT_SHARE = 0.001
#: kind: pattern, group that holds the secret, least length of that group
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "owned": (r"[A-Za-z0-9_-]{20,}", 0, 20),
}
#: What an owned token must have besides its length.
MIXED = (r"[0-9]", r"[A-Za-z]")
ORDER = {k: i for i, k in enumerate(KINDS)}


def _matches(text: Column, kind: str) -> Column:
    """(kind, k, gap, length, secret hash, long enough) of each match; gap counts from the match before."""
    pattern, group, least = KINDS[kind]
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"))
    real = F.filter(found, lambda x: x["all"].isNotNull())

    def row(x: Column, i: Column) -> Column:
        secret = F.regexp_extract(x["all"], pattern, group) if group else x["all"]
        ok = F.char_length(secret) >= least
        for need in MIXED if kind == "owned" else ():
            ok &= secret.rlike(need)
        return F.struct(
            F.lit(ORDER[kind]).alias("kind"), i.alias("k"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["all"]).alias("length"),
            F.sha2(secret, 256).alias("secret"), ok.alias("ok"),
        )

    rows = F.transform(real, row)
    return F.when(text.rlike(pattern), rows)


def scan(docs: DataFrame) -> DataFrame:
    """A row per document row: doc_id, row, source, found; ``row`` identifies it."""
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast("array<struct<kind:int,k:int,gap:int,length:int,secret:string,ok:boolean>>")
    found = F.concat(*(F.coalesce(_matches(text, k), empty) for k in KINDS))
    return materialise(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "source", found.alias("found")), "scan")


def spans(scanned: DataFrame) -> DataFrame:
    """(row, spans): each span with kind, start, end and whether its secret is widely copied."""
    each = scanned.filter(F.size("found") > 0).select("row", "source", F.inline("found"))
    before = W.partitionBy("row", "kind").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.col("length")).over(before)
    placed = each.select("row", "source", "kind", "secret", "ok", (end - F.col("length")).alias("start"), end.alias("end")).filter("ok")
    owner = F.substring_index("source", "/", 1)
    pairs = placed.groupBy("secret", F.coalesce("source", F.lit("\x00")).alias("repository"), F.coalesce(owner, F.lit("\x00")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("secret").agg(F.countDistinct("owner").alias("owners"), F.sum("n").alias("n"))
    copied = materialise(owners.filter(F.col("owners") > COPIED_OWNERS).select(F.col("secret").alias("s"), "n"), "copied")
    flagged = _flagged(placed, copied)
    span = F.struct("start", "kind", "end", "copied")
    per_row = flagged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    base, rest = F.filter("spans", lambda s: s["kind"] < 3), F.filter("spans", lambda s: (s["kind"] == 3) & ~s["copied"])
    apart = F.filter(rest, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return per_row.withColumn("base", base).select("row", F.array_sort(F.concat("base", apart)).alias("spans"))


def _flagged(placed: DataFrame, copied: DataFrame) -> DataFrame:
    """``placed`` with the column ``copied``; occurrences of a hot secret stay where they are."""
    size = size_of(copied)
    if size <= BROADCAST_BYTES:
        return placed.join(F.broadcast(copied.select("s")), F.col("secret") == F.col("s"), "left").withColumn("copied", F.col("s").isNotNull()).drop("s")
    least = HOT_SHARE * (copied.agg(F.sum("n")).first()[0] or 0)
    hot, cold = copied.filter(F.col("n") > least).select("s"), copied.filter(F.col("n") <= least).select("s")
    first = placed.join(F.broadcast(hot), F.col("secret") == F.col("s"), "left").withColumn("hot", F.col("s").isNotNull()).drop("s")
    rest = first.filter("NOT hot").join(cold, F.col("secret") == F.col("s"), "left").withColumn("copied", F.col("s").isNotNull()).drop("s", "hot")
    return first.filter("hot").withColumn("copied", F.lit(True)).drop("hot").unionByName(rest)


def _listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts, the digest of base spans and all spans of every document row."""
    scanned = scan(docs)
    found = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,copied:boolean>>"))
    out = scanned.select("doc_id", "row").join(spans(scanned), "row", "left").withColumn("spans", found)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == ORDER[kind])).cast("long").alias(f"n_{kind}")

    counts = map(count, list(KINDS)[:3])
    base = F.filter("spans", lambda s: s["kind"] < 3)
    live = F.size(F.filter("spans", lambda s: ~s["copied"])).cast("long")
    return out.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), live.alias("n_live"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of a base kind or an owned token replaced by ``[SECRET]``; n_chars follows.

    Equal texts have equal spans, so texts are read where they lie and meet a table of text hashes and spans.
    Columns may have any names that don't begin with ``loomkv_``.
    """
    scanned = scan(docs.select(F.xxhash64("text").alias("doc_id"), "text", "source"))
    found = spans(scanned).filter(F.size("spans") > 0).join(scanned.select("row", F.col("doc_id").alias("loomkv_h")), "row")
    hit = materialise(found.groupBy("loomkv_h").agg(F.min("spans").alias("loomkv_spans")), "hits")
    hit = broadcast_if(hit, size_of(hit), BROADCAST_BYTES)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int")
        part = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), gap), F.when(s["start"] >= acc["at"], F.lit("[SECRET]")).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), part.alias("out"))

    whole = F.aggregate("loomkv_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.char_length("text"))))
    joined = docs.join(hit, F.xxhash64("text") == F.col("loomkv_h"), "left").withColumn("text", F.when(F.col("loomkv_spans").isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("loomkv_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return joined.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def _kind_sql(kind: str) -> str:
    pattern, group, least = KINDS[kind]
    pattern = pattern.replace("'", "''")
    secret = f"regexp_extract(s, '{pattern}', {group})"
    mixed = "".join(f" AND regexp_matches(s, '{x}')" for x in (MIXED if kind == "owned" else ()))
    return f"""SELECT n, '{kind}' AS kind, {ORDER[kind]} AS ord, e - length(s) AS a, e AS b, sha256({secret}) AS h, length({secret}) >= {least}{mixed} AS ok FROM (
  SELECT n, s, sum(length(g) + length(s)) OVER (PARTITION BY n ORDER BY k) AS e FROM (
    SELECT n, unnest(m) AS s, unnest(list_slice(string_split_regex(text, '{pattern}'), 1, len(m))) AS g, unnest(range(len(m))) AS k
    FROM (SELECT n, text, regexp_extract_all(text, '{pattern}') AS m FROM d) WHERE len(m) > 0))"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(map(_kind_sql, KINDS))}),
p AS (SELECT f.*, coalesce(source, chr(1)) AS repository, coalesce(split_part(source, '/', 1), chr(1)) AS owner FROM f JOIN d USING (n) WHERE ok),
o AS (SELECT h, count(DISTINCT owner) > {COPIED_OWNERS} AS copied FROM p GROUP BY h),
x AS (SELECT n, kind, ord, a, b, copied FROM p JOIN o USING (h)),
k AS (SELECT * FROM x WHERE ord < 3 OR (NOT copied AND NOT EXISTS (SELECT 1 FROM x y WHERE y.n = x.n AND y.ord < 3 AND y.a < x.b AND x.a < y.b))),
g AS (SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, ord) AS spans,
  count(*) FILTER (NOT copied) AS n_live FROM k GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN g USING (n)
"""
