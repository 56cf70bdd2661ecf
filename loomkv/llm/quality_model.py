"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its hashed words, of character n-grams that run over word ends, and of
a mark for each word equal to the word before it; a softmax layer reads the average.  Vectors and layer are trained
by numpy stochastic gradient descent on a bounded sample of labelled rows.  Because averaging is linear, the trained
vectors fold into one number per bucket and a document costs one lookup per feature.

Defined results: null and empty texts have no feature and get the score of the bias; null or missing labels teach
nothing; without both labels every score is the share of label 1; repeated rows return each for itself; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.llm.common import table

BUCKETS, DIM = 1 << 17, 8
N_GRAMS = (3, 5)
#: The model is fitted on at most so many labelled rows of at most so many bytes each.
TRAIN_ROWS, TRAIN_BYTES = 4000, 40_000
EPOCHS, RATE = 6, 0.5
CUT = 0.7
REPEAT = 0


def features(text: str) -> np.ndarray:
    """Buckets of all features of a text, repeats included."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint32)
    joined = " ".join(words)
    ids = np.fromiter(map(zlib.crc32, joined.encode("utf-8", "replace").split(b" ")), np.uint32, len(words))
    again = np.full(int((ids[1:] == ids[:-1]).sum()), REPEAT, np.uint32)
    parts = [ids]
    b = np.frombuffer(f" {joined} ".encode("utf-32-le", "replace"), np.uint32)
    for n in N_GRAMS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, 2_166_136_261 + n, np.uint32)
            for k in range(n):
                h = (h ^ b[k : len(b) - n + 1 + k]) * np.uint32(16_777_619)
            parts.append(h ^ (h >> np.uint32(15)))
    # bucket 0 is the mark's own
    return np.concatenate([np.concatenate(parts) % np.uint32(BUCKETS - 1) + np.uint32(1), again])


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) of the log odds of label 1."""
    y = np.array(labels, np.int64)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([0.0, prior], np.float32)
    rows = []
    for t in texts:
        ids, counts = np.unique(features(t), return_counts=True)
        rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)[:, None]))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            ids, w = rows[i]
            if not len(ids):
                continue
            own = vectors[ids]
            mean = (own * w).sum(0)
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            # weights are shares of a text; the step is scaled up by their mean so that long texts teach too
            vectors[ids] = own - rate * np.minimum(1.0, w * len(ids)) * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on the labelled rows with the least hashes of their id, never on held-out ones."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # at most TRAIN_ROWS rows on the small side
    found = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id")
    rows = found.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(TRAIN_ROWS).toPandas()
    return train(rows["text"].tolist(), rows["quality"].astype(int).tolist())


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = known.value
        for part in texts:
            z = np.full(len(part), bias)
            for i, t in enumerate(part):
                if t and len(ids := features(t)):
                    z[i] += weights[ids].mean(dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), probability("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
