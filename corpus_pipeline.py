"""Corpus pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.  Filtering stages know
rows by doc_id and a hash of the text, so only rows alike in both share a decision.  They decide on narrow tables and
keep just the decisions that change something; texts are read where they lie unless those decisions are too many to
be broadcast.  Null doc_ids are one more id.  Further columns may have any names that don't begin with ``loomkv_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.llm import decontaminate, language_id, near_copies, packing, secrets
from loomkv.llm.common import broadcast_if, join_hot, materialise, size_of, table

#: Measured bytes of decisions up to which they are broadcast; beyond, documents and decisions are shuffled.
BROADCAST_BYTES = 16 << 20


def _decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` with the further columns of ``decisions`` (loomkv_k, loomkv_d, ...), null where there is none."""
    held = materialise(decisions, "decisions")
    digested = docs.withColumn("loomkv_digest", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("loomkv_k")) & (F.col("loomkv_digest") == F.col("loomkv_d"))
    return digested.join(broadcast_if(held, size_of(held), BROADCAST_BYTES), same, "left")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``lang`` becomes the fused decision."""
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("digest"), "lang").alias("key"), "text", F.col("lang").alias("declared"), language_id.host_of(F.col("source")).alias("host"))
    found = language_id.identify(rows).groupBy(F.col("key.doc_id").alias("loomkv_k"), F.col("key.digest").alias("loomkv_d")).agg(
        F.min(F.when(F.col("kept"), F.col("pred_lang"))).alias("loomkv_lang"), F.min("key.lang").alias("loomkv_low"), F.max("key.lang").alias("loomkv_high"), F.bool_or(F.col("key.lang").isNull()).alias("loomkv_none")
    )
    same = F.coalesce((F.col("loomkv_low") == F.col("loomkv_lang")) & (F.col("loomkv_high") == F.col("loomkv_lang")) & ~F.col("loomkv_none"), F.lit(False))
    changed = found.filter(~same).select("loomkv_k", "loomkv_d", F.coalesce("loomkv_lang", F.lit("")).alias("loomkv_lang"), F.col("loomkv_lang").isNull().alias("loomkv_drop"))
    kept = _decided(docs, changed).filter(~F.coalesce("loomkv_drop", F.lit(False)))
    return kept.withColumn("lang", F.coalesce("loomkv_lang", "lang")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that of the smallest doc_id, then of the least digest."""
    rows = materialise(near_copies.near_copies(docs), "near-copies")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))
    groups = materialise(rows.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    more = join_hot(rows, groups, "root", "n").groupBy("doc_id", "digest").agg(F.bool_and(place == F.col("first")).alias("is_first"), F.count(F.lit(1)).alias("rows"))
    # a first that stands alone needs no decision, one that repeats is kept once
    decisions = more.filter("NOT is_first OR rows > 1").select(F.col("doc_id").alias("loomkv_k"), F.col("digest").alias("loomkv_d"), F.col("is_first").alias("loomkv_again"))
    decisions = materialise(decisions, "decisions")
    rest = _decided(docs, decisions).filter(F.col("loomkv_again").isNull()).select(*docs.columns)
    repeated = decisions.filter("loomkv_again")
    if repeated.isEmpty():
        return rest
    once = _decided(docs, repeated).filter("loomkv_again").dropDuplicates(["doc_id", "loomkv_digest"]).select(*docs.columns)
    return rest.unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate.phrase_search(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("loomkv_k"), F.col("digest").alias("loomkv_d"), F.lit(True).alias("loomkv_drop"))
    return _decided(docs, found.distinct()).filter(F.col("loomkv_drop").isNull()).select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]
#: Trained models, links of near copies and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
