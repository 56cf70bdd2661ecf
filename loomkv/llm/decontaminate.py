"""Benchmark decontamination over a positional inverted index (DataFrame functions only).

The index holds one posting (term, document, pos) per stored occurrence; a document is known by its id and a hash of
its text, so rows that share an id, or have none, stay apart.  A phrase search starts from the
rarest terms of each phrase window: their postings, shifted by the term's place in the item, fall on the
same diagonal (document, item, shift) when the phrase is there.  Diagonals on which both rarest terms of
some window meet are confirmed word by word; everything else is never looked at again.

Defined results: a null or empty text has no words and no hits; an item without words has no window; a null
doc_id or item_id is an ordinary value (items without id hit words but are not counted as items); repeated rows each
get their own equal result.  Additional input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkv.llm.common import broadcast_if, lower_ascii, materialise, table

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Measured bytes up to which a table derived from the benchmark or the ids of candidate documents are broadcast.
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Lower-cased words of a text, an empty array for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def weight(rows: DataFrame, *texts: str) -> int:
    """Bytes of a table: its texts and 32 for each row."""
    each = F.lit(32).cast("long")
    for x in texts:
        each = each + F.coalesce(F.octet_length(x), F.lit(0))
    return rows.agg(F.sum(each)).first()[0] or 0


def postings(docs: DataFrame, terms: DataFrame | None = None, n_bytes: int = 0) -> DataFrame:
    """The positional index: a row (doc_id, digest, pos, term) per occurrence; only of ``terms`` where given."""
    out = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return out if terms is None else out.join(broadcast_if(terms, n_bytes, BROADCAST_BYTES), "term", "left_semi")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, iw): distinct items with words; ``item`` identifies id and words."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    item = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("item_id").cast("string"), F.lit("\x01")), F.concat_ws(" ", "iw")), 256)
    return rows.withColumn("item", item).dropDuplicates(["item"])


def _anchors(items: DataFrame, frequency: DataFrame, n: int) -> DataFrame:
    """(item, a1, a2): places of the two rarest terms of each window whose terms all occur in the corpus."""
    spots = items.select("item", F.posexplode("iw").alias("ipos", "term")).join(frequency, "term", "left")
    spots = spots.withColumn("n_occ", F.coalesce("n_occ", F.lit(0)))
    per_item = spots.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("ipos", "n_occ"))).alias("spots"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("spots") - n, F.lit(0)))
    window = F.transform(F.slice("spots", F.col("start") + 1, n), lambda x: F.struct(x["n_occ"], x["ipos"]))
    rare = per_item.select("item", "spots", F.explode(starts).alias("start")).select("item", F.array_sort(window).alias("w"))
    first, second = F.get("w", F.lit(0)), F.coalesce(F.get("w", F.lit(1)), F.get("w", F.lit(0)))
    return rare.filter(first["n_occ"] > 0).select("item", first["ipos"].alias("a1"), second["ipos"].alias("a2")).distinct()


def _confirmed(found: Column, text_words: Column, n: int) -> Column:
    """Places of document words inside an occurrence of a window on a diagonal."""
    length = F.least(F.lit(n), F.size(found["iw"]))

    def here(s: Column) -> Column:
        at = found["shift"] + s
        return (at >= 0) & (at + length <= F.size(text_words)) & (
            F.slice(text_words, F.greatest(at, F.lit(0)) + 1, length) == F.slice(found["iw"], s + 1, length)
        )

    starts = F.filter(F.sequence(F.lit(0), F.size(found["iw"]) - length), here)
    return F.flatten(F.transform(starts, lambda s: F.sequence(found["shift"] + s, found["shift"] + s + length - 1)))


def phrase_search(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, digest, hits, items): exact matches of the windows of ``n`` words, for documents with any.

    ``hits`` are the places of hit words, ``items`` the ids whose windows occur; ``digest`` identifies the text.
    """
    items = materialise(items_of(benchmark), "items")
    items_bytes = weight(items.withColumn("words", F.concat_ws("    ", "iw")), "item", "words")
    terms = items.select(F.explode("iw").alias("term")).distinct()
    frequency = postings(docs, terms, weight(terms, "term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_occ"))
    pairs = materialise(_anchors(items, frequency, n), "anchors")
    spots = pairs.select("item", F.explode(F.array("a1", "a2")).alias("ipos")).distinct()
    spots = spots.join(items.select("item", "iw"), "item").select("item", "ipos", F.get("iw", F.col("ipos")).alias("term"))
    anchors = materialise(spots, "spots")
    rare = anchors.select("term").distinct()
    index = materialise(postings(docs, rare, weight(rare, "term")), "postings")
    diagonals = (
        index.join(broadcast_if(anchors, weight(anchors, "item", "term"), BROADCAST_BYTES), "term")
        .groupBy("doc_id", "digest", "item", (F.col("pos") - F.col("ipos")).alias("shift"))
        .agg(F.collect_set("ipos").alias("seen"))
    )
    wanted = items.select("item", "item_id", "iw").join(pairs.groupBy("item").agg(F.collect_set(F.struct("a1", "a2")).alias("pairs")), "item")
    both = F.exists("pairs", lambda p: F.array_contains("seen", p["a1"]) & F.array_contains("seen", p["a2"]))
    candidates = materialise(
        diagonals.join(broadcast_if(wanted, items_bytes + weight(pairs, "item"), BROADCAST_BYTES), "item").filter(both).select(F.col("doc_id").alias("c_id"), F.col("digest").alias("c_digest"), "item", "shift"), "diagonals"
    )
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest"))
    ids = candidates.select("c_id", "c_digest").distinct()
    within = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").join(broadcast_if(ids, weight(ids), BROADCAST_BYTES), same, "left_semi")
    texts = within.dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", words(F.col("text")).alias("w"))
    known = broadcast_if(items.select("item", "item_id", "iw"), items_bytes, BROADCAST_BYTES)
    # a row per diagonal; only the places of real hits are gathered, at most the words of the text
    each = texts.join(broadcast_if(candidates, weight(candidates, "item"), BROADCAST_BYTES), same).join(known, "item")
    checked = each.select("doc_id", "digest", "item_id", _confirmed(F.struct("iw", "shift"), F.col("w"), n).alias("at")).filter(F.size("at") > 0)
    found = checked.groupBy("doc_id", "digest").agg(F.collect_list("at").alias("at"), F.collect_set("item_id").alias("items"))
    return found.select("doc_id", "digest", F.array_distinct(F.flatten("at")).alias("hits"), "items")


def proximity_search(docs: DataFrame, queries: DataFrame, within: int, most: int = 3) -> DataFrame:
    """(doc_id, digest, query, start, end): spans of at most ``within`` words that hold all terms of a query.

    ``queries`` has (query, terms) with at most ``most`` different terms each; none or null matches nothing.  There is
    one span for each posting that ends one: the shortest.  It runs over the postings of the queries' terms alone:
    beside each posting, the latest place of every other term.
    """
    asked = queries.select("query", F.array_distinct("terms").alias("terms")).filter(F.size("terms").between(1, most)).select("query", F.size("terms").alias("n"), F.posexplode("terms").alias("slot", "term"))
    asked = materialise(asked, "asked")
    terms = asked.select("term").distinct()
    index = postings(docs, terms, weight(terms, "term")).distinct()
    hits = index.join(broadcast_if(asked, weight(asked, "term"), BROADCAST_BYTES), "term")
    so_far = W.partitionBy("doc_id", "digest", "query").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = [F.max(F.when(F.col("slot") == i, F.col("pos"))).over(so_far) for i in range(most)]
    placed = hits.select("doc_id", "digest", "query", "n", F.array(*last).alias("last"), F.col("pos").alias("end"))
    held = F.filter("last", lambda x: x.isNotNull())
    spans = placed.filter(F.size(held) == F.col("n")).select("doc_id", "digest", "query", F.array_min(held).alias("start"), "end")
    return spans.filter(F.col("end") - F.col("start") < within)


def rarest_terms(docs: DataFrame, benchmark: DataFrame, most: int = 3) -> DataFrame:
    """(query, terms): the rarest of the different terms of each item id that occur in the corpus at all."""
    asked = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").alias("query"), F.explode(words(F.col("text"))).alias("term")).distinct()
    asked = materialise(asked, "item-terms")
    terms = asked.select("term").distinct()
    frequency = postings(docs, terms, weight(terms, "term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = asked.join(frequency, "term").withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("n", "term")))
    return ranked.filter(F.col("rank") <= most).groupBy("query").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """A row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits."""
    found = phrase_search(docs, benchmark, n).withColumnsRenamed({"doc_id": "f_id", "digest": "f_digest"})
    base = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest"))
    ids = F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda x: x.cast("string"))
    n_hit = F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits"))
    return base.join(found, same, "left").select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.array_sort("hits").alias("hits"),
    )


#: Words within which an item's rarest terms count as a proximity match.
NEAR = 40


def proximity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_spans, first_start, shortest) of documents in which an item's rarest terms lie close together."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    spans = proximity_search(docs, materialise(rarest_terms(docs, benchmark), "rarest"), NEAR)
    found = spans.groupBy("doc_id", "digest", F.col("query").alias("item_id"))
    return found.agg(F.count(F.lit(1)).alias("n_spans"), F.min("start").cast("long").alias("first_start"), F.min(F.col("end") - F.col("start") + 1).cast("long").alias("shortest")).drop("digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS k FROM bw),
dw AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
PROXIMITY_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
b AS (SELECT DISTINCT item_id, unnest({_SQL_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT doc_id, text, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, text, {_SQL_WORDS} AS w FROM d)),
i AS (SELECT p.* FROM p SEMI JOIN b ON p.term = b.term),
f AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS slot FROM b JOIN (
  SELECT w AS term, count(*) AS n FROM (SELECT unnest({_SQL_WORDS}) AS w FROM documents) GROUP BY 1) USING (term) QUALIFY slot <= 3),
h AS (SELECT doc_id, text, item_id, slot, pos, count(*) OVER (PARTITION BY item_id, doc_id, text) AS c FROM i JOIN f USING (term)),
n AS (SELECT item_id, count(*) AS n FROM f GROUP BY 1),
l AS (SELECT h.*, n.n, max(CASE WHEN slot = 1 THEN pos END) OVER w AS a, max(CASE WHEN slot = 2 THEN pos END) OVER w AS b, max(CASE WHEN slot = 3 THEN pos END) OVER w AS c3
  FROM h JOIN n USING (item_id) WINDOW w AS (PARTITION BY doc_id, text, item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT doc_id, text, item_id, pos, least(a, b, c3) AS start FROM l WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c3 IS NOT NULL)::INT = n)
SELECT doc_id, item_id, count(*) AS n_spans, min(start)::BIGINT AS first_start, min(pos - start + 1)::BIGINT AS shortest FROM s WHERE pos - start < {NEAR} GROUP BY doc_id, text, item_id
"""
