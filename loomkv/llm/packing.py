"""Best-fit packing of documents into sequences by pattern packing.

Documents become pieces of at most ``capacity`` tokens.  The histogram of piece lengths, at most ``capacity``
numbers, is all that the driver sees.  Patterns of two or three lengths, of the latter every so-manieth so that there
are ``MAX_PATTERNS`` at most (which bounds the fit; pieces that no kept pattern holds are left to the residual), that fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares and rounded down.  Patterns that leave
over a hundredth of a sequence empty, as those of short lengths do, are not used; what is left is packed best-fit, again as repeated patterns.  The plan is arithmetic: the k-th piece of a length lies in a
known sequence at a known offset, so pieces are placed without moving tokens.

Defined results: null and empty texts are one piece of the end id; repeated rows are packed each for itself; an
empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkv.llm import tokens
from loomkv.llm.common import give_back, materialise, table

CAPACITY = 1024
MAX_PATTERNS = 4000
#: A fitted pattern is used from this share of the capacity on.
LEAST_FILL = 0.99
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece; only documents over ``capacity`` are cut, and their first piece may be shorter."""
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        for rows in parts:
            for some in tokens.slices(rows):
                ids, counts = coder.encode(some.column("text"))
                n = counts + 1
                ends = np.cumsum(n)
                out = np.full(int(ends[-1]), end_id, "<u4")
                inside = np.ones(len(out), bool)
                inside[ends - 1] = False
                out[inside] = ids
                raw = memoryview(out).cast("B")
                many = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                # the first piece takes what the full ones leave
                to = n[doc] - (many[doc] - 1 - piece) * capacity
                start = np.maximum(to - capacity, 0)
                first = (ends - n)[doc]
                spans = list(zip((4 * (first + start)).tolist(), (4 * (first + to)).tolist(), strict=True))
                crc = [zlib.crc32(raw[x:y]) for x, y in spans]
                columns = [some.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(to - start), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array([bytes(raw[x:y]) for x, y in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def patterns(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Two and three lengths out of ``lengths`` (ascending) that fill a sequence as far as these can."""
    have, out = set(lengths), set()

    def best(room: int) -> int | None:
        i = bisect.bisect_right(lengths, room)
        return lengths[i - 1] if i else None

    for a in lengths:
        if (b := best(capacity - a)) is not None:
            out.add(tuple(sorted((a, b))))
    full = [(a, b, capacity - a - b) for i, a in enumerate(lengths) for b in lengths[i:] if capacity - a - b >= b and capacity - a - b in have]
    step = max(1, len(full) // max(1, MAX_PATTERNS - len(out)))
    return sorted(out | set(full[::step]))


def fit(histogram: dict[int, int], chosen: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by coordinate descent."""
    left = {k: float(v) for k, v in histogram.items()}
    columns = [list(Counter(p).items()) for p in chosen]
    norms = [sum(m * m for _, m in c) for c in columns]
    x = np.zeros(len(chosen))
    enough = 1e-3 * max(1.0, max(left.values(), default=1.0))
    for _ in range(sweeps):
        moved = 0.0
        for i, c in enumerate(columns):
            new = max(0.0, x[i] + sum(m * left[k] for k, m in c) / norms[i])
            if d := new - x[i]:
                x[i] = new
                moved = max(moved, abs(d))
                for k, m in c:
                    left[k] -= m * d
        if moved < enough:
            break
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold every piece of ``histogram`` exactly once."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if len(left) > 1:
        chosen = [p for p in patterns(sorted(left), capacity) if LEAST_FILL * capacity <= sum(p) <= capacity]
        x = fit(left, chosen)
        for i in np.argsort(-x, kind="stable"):
            need = Counter(chosen[i])
            n = min(int(x[i]), *(left[k] // m for k, m in need.items()))
            if n > 0:
                out.append((chosen[i], n))
                for k, m in need.items():
                    left[k] -= m * n
    keys = sorted(k for k, v in left.items() if v > 0)
    while keys:
        need: Counter = Counter()
        room = capacity
        i = len(keys) - 1
        while i >= 0:
            i = bisect.bisect_right(keys, room, 0, i + 1) - 1
            if i < 0:
                break
            k = keys[i]
            take = min(room // k, left[k] - need[k]) if need else 1
            need[k] += take
            room -= take * k
            if take and left[k] > need[k] and k <= room:
                continue
            i -= 1
        n = min(left[k] // m for k, m in need.items())
        out.append((tuple(sorted(need.elements(), reverse=True)), n))
        for k, m in need.items():
            left[k] -= m * n
        keys = [k for k in keys if left[k] > 0]
    return out


def places(made: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first ordinal, first sequence, offset), ascending; a row runs to the next one's ordinal."""
    used: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, n in made:
        offset = 0
        for k in lengths:
            rows.setdefault(k, []).append((used[k], sequence, offset))
            used[k] += n
            offset += k
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a row per piece with doc_id, piece and length) with sequence_id and offset.

    Full pieces are sequences of their own.  The others are numbered within their length: by bucket of a hash,
    with bucket offsets from one grouped count, so that no length meets in one task.
    """
    # the salt, written once, parts rows that are alike in all columns
    cut = materialise(cut.withColumn("salt", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())), "pieces")
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.filter(F.col("length") < capacity)
    buckets = min(4096, max(64, rest.count() // 4_000_000))
    rest = rest.withColumn("bucket", F.pmod("salt", F.lit(buckets)).cast("int"))
    # at most capacity * buckets numbers, whatever the number of pieces
    counts = rest.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["length", "bucket"])
    histogram = {int(k): int(v) for k, v in counts.groupby("length")["n"].sum().items()}
    firsts = np.zeros((capacity, buckets), np.int64)
    firsts[counts["length"], counts["bucket"]] = counts.groupby("length")["n"].cumsum() - counts["n"]
    known = cut.sparkSession.sparkContext.broadcast((places(plan(histogram, capacity)), firsts))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, bucket: pd.Series, number: pd.Series) -> pd.DataFrame:
        at, first = known.value
        out = np.zeros((len(length), 2), np.int64)
        lengths, buckets, numbers = (x.to_numpy() for x in (length, bucket, number))
        for k in np.unique(lengths):
            here = np.flatnonzero(lengths == k)
            ordinal = numbers[here] - 1 + first[k, buckets[here]]
            rows = at[int(k)]
            hit = rows[np.searchsorted(rows[:, 0], ordinal, "right") - 1]
            out[here, 0], out[here, 1] = hit[:, 1] + ordinal - hit[:, 0], hit[:, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "salt")
    placed = rest.withColumn("number", F.row_number().over(order)).withColumn("to", place("length", "bucket", "number"))
    columns = [x for x in cut.columns if x != "salt"]
    return placed.select(*columns, "to.sequence_id", "to.offset").unionByName(full.select(*columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with their places, by the byte-level tokenizer."""
    return pack(pieces(docs, tokens.tokenizer_path("byte_bpe_50k.json"), capacity=capacity), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
