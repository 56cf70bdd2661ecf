"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join.

Four differing bits leave at least one of five bit blocks untouched, so every link lies inside some bucket of
fingerprints that agree on a block.  Inside a bucket the sorted fingerprints are a binary trie: pairs of nodes
walk down together, each step adds the bit in which they differ, and a pair whose sum passes the budget is cut
off.  A bucket gives back the edges of a spanning star, not its pairs, so a group of copies costs its size.
Buckets over ``HOT_BUCKET`` fingerprints are split, each within itself, by five further blocks of the bits still free,
until none is larger or ``MOST_MASKS`` different masks have such buckets.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; repeated rows keep
their own result; a null doc_id takes part but is never a component's id unless it has no other; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.llm.common import join_hot, materialise, table
from loomkv.llm.graph import connected_components, unite

BUDGET = 4
HOT_BUCKET = 20_000
MOST_MASKS = 1000
#: Fingerprints that one pass of the trie takes, and node pairs that it holds at a time.
PASS_ROWS, FRONTIER = 200_000, 400_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), 0
    hashes = np.fromiter((digest(g, 42) for g in map(b" ".join, grams)), np.uint64)
    for at in range(0, len(hashes), 65_280):
        part = hashes[at : at + 65_280]
        n += len(part)
        bits = np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, digest, fp): fp is the fingerprint as a signed long, digest tells texts of one doc_id apart."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in part], np.uint64).view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), fp("text").alias("fp"))


def _blocks(free: list[int], n: int) -> list[int]:
    """Masks that split the bit positions ``free`` into ``n`` blocks."""
    return [sum(1 << b for b in x.tolist()) for x in np.array_split(np.array(free, dtype=np.int64), n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1 … for each range, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - lo, size)


def trie_links(bucket: np.ndarray, fp: np.ndarray, budget: int = BUDGET, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (place, root place) of the components under ``budget`` within each bucket.

    ``bucket`` and ``fp`` (unsigned, a word or a row of words each) are sorted together; a bucket holds each fingerprint once.
    """
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    words = [np.ascontiguousarray(w) for w in fp.reshape(n, -1).T]
    depths = 64 * len(words)

    def count_ones(d: int) -> np.ndarray:
        return np.concatenate(([0], np.cumsum((words[d // 64] >> np.uint64(63 - d % 64)) & np.uint64(1), dtype=np.int64)))

    ones = [count_ones(d) for d in range(depths)] if n <= 4096 else None

    def ones_at(d: int) -> np.ndarray:
        return ones[d] if ones else count_ones(d)

    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    keep = hi - lo > 1
    stack = [(0, lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(int(keep.sum()), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        done = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (label[alo] == label[blo])
        alo, ahi, blo, bhi, diff = (x[~done] for x in (alo, ahi, blo, bhi, diff))
        if len(alo) > frontier:
            half = len(alo) // 2
            stack += [(depth, alo[half:], ahi[half:], blo[half:], bhi[half:], diff[half:]), (depth, alo[:half], ahi[:half], blo[:half], bhi[:half], diff[:half])]
            continue
        small = (ahi - alo) * (bhi - blo) <= 16
        if depth == depths:
            small[:] = True
        if small.any():
            a0, a1, b0, b1 = (x[small] for x in (alo, ahi, blo, bhi))
            per_a = np.repeat(np.arange(len(a0)), a1 - a0)
            a = _ranges(a0, a1 - a0)
            width = (b1 - b0)[per_a]
            a, b = np.repeat(a, width), _ranges(b0[per_a], width)
            near = (a < b) & (sum((np.bitwise_count(w[a] ^ w[b]) for w in words), np.uint16(0)) <= budget)
            unite(label, a[near], b[near])
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        o = ones_at(depth)
        amid, bmid = ahi - (o[ahi] - o[alo]), bhi - (o[bhi] - o[blo])
        own = alo == blo
        kids = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1)]
        kids.append(tuple(x[~own] for x in (amid, ahi, blo, bmid, diff + 1)))
        parts = [np.concatenate(x) for x in zip(*kids, strict=True)]
        a0, a1, b0, b1, d = parts
        live = (a1 > a0) & (b1 > b0) & (d <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        stack.append((depth + 1, *(x[live] for x in parts)))
    other = np.flatnonzero(label != np.arange(n))
    return other, label[other]


def _bucket_links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star edges of the buckets of a partition that is sorted by bucket and fp."""

    def solve(x: pd.DataFrame) -> pd.DataFrame:
        same = ((x["mask"].diff() != 0) | (x["key"].diff() != 0)).cumsum().to_numpy()
        fp = x["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, same))
        a, root = trie_links(same[order], fp[order])
        signed = fp[order].view(np.int64)
        return pd.DataFrame({"a": signed[a], "b": signed[root]})

    held: list[pd.DataFrame] = []
    rows = 0
    for part in parts:
        if not len(part):
            continue
        held.append(part)
        rows += len(part)
        if rows < PASS_ROWS:
            continue
        x = pd.concat(held, ignore_index=True)
        last = ((x["mask"] == x["mask"].iloc[-1]) & (x["key"] == x["key"].iloc[-1])).to_numpy()
        if not last.all():
            yield solve(x[~last])
        held, rows = [x[last]], int(last.sum())
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def links(distinct_fp: DataFrame, budget: int = BUDGET, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of ``fp`` within ``budget`` bits."""
    if budget != BUDGET:
        raise ValueError("the blocks are cut for a budget of four bits")
    masks = {0: _blocks(list(range(64)), budget + 1)}
    rows = distinct_fp.select("fp", F.lit(0).cast("long").alias("mask"))
    ready = []
    while True:
        table_of = F.create_map(*(y for m, kids in masks.items() for y in (F.lit(_signed(m)).cast("long"), F.array(*(F.lit(_signed(m | k)).cast("long") for k in kids)))))
        rows = rows.select("fp", F.explode(F.element_at(table_of, F.col("mask"))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = materialise(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "hot")
        free = {m: [b for b in range(64) if not m >> b & 1] for (m,) in large.select("mask").distinct().collect() if m is not None}
        free = {m & (1 << 64) - 1: bits for m, bits in free.items()}
        n_large = large.count()
        if not n_large or len(free) * (budget + 1) > MOST_MASKS or any(len(bits) <= budget for bits in free.values()):
            break
        # at most rows / hot buckets are large, so the list of them is small beside the table
        large = F.broadcast(large.drop("n")) if n_large <= 100_000 else large.drop("n")
        ready.append(rows.join(large, ["mask", "key"], "left_anti").select("fp", "mask", "key"))
        rows = rows.join(large, ["mask", "key"], "left_semi").select("fp", "mask")
        # a bucket's mask holds all the bits agreed on so far
        masks = {m: _blocks(bits, budget + 1) for m, bits in free.items()}
    for x in ready:
        rows = rows.unionByName(x)
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.select("mask", "key", "fp").mapInPandas(_bucket_links, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, digest, fp, root, component_id, class_size): component_id is the smallest doc_id reachable over links.

    ``root``, the least fingerprint of the component, names it also where it has no doc_id.
    """
    prints = materialise(fingerprints(docs, shingle), "fp")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    roots = connected_components(links(classes.select("fp")))
    named = materialise(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "class_size", F.coalesce("root", "fp").alias("root")), "named")
    ids = materialise(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "ids")
    whole = materialise(join_hot(named, ids, "root", "n"), "components")
    return join_hot(prints, whole, "fp", "class_size").select("doc_id", "digest", "fp", "root", "component_id", "class_size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
