"""Near copies by SimHash and exact Jaccard similarity of five-word shingles, ``SIMILAR`` or more, for the pipeline.

Op4's method with fingerprints of its own: a bit is 1 if it is set in over half the shingles' hashes.  At a similarity
of 0.8 up to 0.161 of the bits differ, ten of 64: no blocks of 64 bits serve such a budget, so fingerprints are long.
Texts of one set of shingles are one class.  A fingerprint is cut into ``LANES`` blocks of ``LANE_BITS`` bits, and a
pair at 0.8 agrees in none with a chance of at most 4 in a million, a closer pair with less.  Inside the buckets of a
block a trie self-join of the first ``QUICK`` words, with a budget of ``QUICK_BUDGET`` bits, gives spanning stars;
their components are the candidates.  The first ``FIRST`` blocks give components that later blocks only add to, so a
large group is not written out once a block.  (Sets of four and five shingles differ in more bits; they meet by leaving out
each of the five.)  Buckets of over ``HOT`` classes are split into cells of two parts, so no pair is lost.

Exact similarity then decides within each candidate component.  First each class is held against its least one.  Where
that leaves more than one component, ``ROUNDS`` times, those outside the largest are held against a pivot drawn from
it.  What then still differs is compared in full: the candidates are cut into cells of two blocks of at most about
``BLOCK`` classes, and a task compares the unlike pairs of its cell, first by fingerprints, where a pair at 0.8 differs
in over ``BUDGET`` bits with a chance of a few in a million, then by their sets; it gives back links only.  Links are
only pairs whose shingle sets are that similar.

Defined results: words are parted by ASCII blanks and A-Z are lower-cased; a text under five words is one shingle,
and null, empty and blank texts are alike; repeated rows keep their own result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkv.llm import tokens
from loomkv.llm.common import broadcast_if, give_back, join_hot, materialise, size_of
from loomkv.llm.graph import connected_components
from loomkv.llm.simhash import trie_links

SHINGLE = 5
#: A pair is linked from 4/5 on.
SIMILAR = (4, 5)
LANES, LANE_BITS = 96, 12
FIRST = 12
#: Differing bits of a whole fingerprint, and of the words that go with a row of a block, up to which a pair may be similar.
BUDGET = 250
QUICK, QUICK_BUDGET = 3, 58
#: Classes up to which a bucket stays whole; rows that one pass of the trie takes, and node pairs that it holds at a time.
HOT = 200_000
PASS_ROWS, FRONTIER = 50_000, 50_000
ROUNDS, BLOCK = 1, 2000
#: Measured bytes up to which the names of the texts whose sets are wanted, or the open components, are broadcast.
BROADCAST_BYTES = 8 << 20
_STEPS = np.arange(1, LANES * LANE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in map(b" ".join, grams)), np.uint64))


def fingerprint(hashes: np.ndarray) -> bytes:
    """The long fingerprint of a set, ``LANES * LANE_BITS`` bits; each hash is stretched by the SplitMix64 finalizer."""
    total = np.zeros(LANES * LANE_BITS, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes), bitorder="little").tobytes()


def _signed(hashed: int) -> int:
    return hashed - (1 << 64) if hashed >> 63 else hashed


def _name(hashes: np.ndarray) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 1))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, set, sig, less): the hash of the text's set, its fingerprint, and of five the hashes of each four."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for some in tokens.slices(rows):
                sets, sigs, less = [], [], []
                for t in some.column("text").to_pylist():
                    hashes = shingles(t)
                    sets.append(_name(hashes))
                    sigs.append(fingerprint(hashes))
                    less.append([_name(np.delete(hashes, i)) for i in range(5)] if len(hashes) == 5 else [])
                columns = [some.column("doc_id"), some.column("digest"), pa.array(sets, pa.int64()), pa.array(sigs, pa.binary()), pa.array(less, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "set", "sig", "less"])
        give_back()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(sign, f"doc_id {kind}, digest long, set long, sig binary, less array<long>")


def _words(sigs) -> np.ndarray:
    """Fingerprints as rows of unsigned words."""
    return np.frombuffer(b"".join(sigs), "<u8").reshape(-1, len(_STEPS))


def lanes(words: np.ndarray) -> np.ndarray:
    """The bucket of each fingerprint in each block."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    value = bits.reshape(-1, LANES, LANE_BITS) @ (1 << np.arange(LANE_BITS, dtype=np.int32))
    return value + (np.arange(LANES, dtype=np.int32) << LANE_BITS)


_BUCKET = ["bucket", "i", "j"]
_QUICK = [f"w{i}" for i in range(QUICK)]


def _bucket_rows(named: DataFrame, blocks: slice) -> DataFrame:
    """(bucket, name, w0 ...): a row for each fingerprint of ``named`` (name, sig) and block."""

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for at in range(0, len(rows), 200):
                some = rows.slice(at, 200)
                words = _words(some.column("sig").to_pylist())
                buckets = lanes(words)[:, blocks]
                columns = [some.column("name").to_numpy(), *words[:, :QUICK].view("<i8").T]
                columns = [pa.array(buckets.ravel()), *(pa.array(np.repeat(c, buckets.shape[1])) for c in columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "name", *_QUICK])
        give_back()

    return named.mapInArrow(deal, ", ".join(["bucket int, name long", *(f"{w} long" for w in _QUICK)]))


def _bucket_stars(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges between unlike names in the buckets of a partition that is sorted by them."""

    def solve(x: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        within, names = np.cumsum(new), x.column("name").to_numpy()
        words = np.stack([x.column(w).to_numpy() for w in _QUICK], axis=1).view(np.uint64)
        order = np.lexsort((*words.T[::-1], within))
        within, words, names = within[order], words[order], names[order]
        first = np.append(True, (within[1:] != within[:-1]) | (words[1:] != words[:-1]).any(1))
        once, again = np.flatnonzero(first), np.flatnonzero(~first)
        a, root = trie_links(within[once], words[once], QUICK_BUDGET, FRONTIER)
        a, root = np.append(once[a], again), np.append(once[root], once[np.cumsum(first)[again] - 1])
        edges = np.stack([names[a], names[root]], axis=1)
        edges = np.unique(np.sort(edges[edges[:, 0] != edges[:, 1]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in edges.T], names=["a", "b"])

    def starts(x: pa.Table) -> np.ndarray:
        at = np.stack([x.column(c).to_numpy() for c in _BUCKET])
        return np.append(True, (at[:, 1:] != at[:, :-1]).any(0))

    held, rows, wanted = [], 0, PASS_ROWS
    for part in parts:
        held.append(part)
        rows += len(part)
        if rows < wanted:
            continue
        x = pa.Table.from_batches(held)
        new = starts(x)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield solve(x.slice(0, cut), new[:cut])
        held, rows = x.slice(cut).to_batches(), len(x) - cut
        wanted = max(PASS_ROWS, 2 * rows)
    if rows:
        x = pa.Table.from_batches(held)
        yield solve(x, starts(x))
        del x
    del held
    give_back()


def _stars(named: DataFrame, blocks: slice, many: bool) -> DataFrame:
    """(a, b): star edges between the names of fingerprints within ``QUICK_BUDGET`` in the buckets of ``blocks``."""
    rows, parts = _bucket_rows(named, blocks), F.lit(1).cast("long")
    if many:
        # at most rows / HOT buckets are large
        large = rows.groupBy(F.col("bucket").alias("large")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
        rows = rows.join(F.broadcast(materialise(large, "hot")), F.col("bucket") == F.col("large"), "left")
        parts = F.coalesce(F.ceil(F.col("n") / F.lit(HOT)), parts)
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(*_QUICK), F.col("parts")))
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.struct(F.least("own", x).cast("int").alias("i"), F.greatest("own", x).cast("int").alias("j")))
    rows = rows.withColumn("cell", F.explode(cell)).select("bucket", "cell.i", "cell.j", "name", *_QUICK)
    return rows.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET).mapInArrow(_bucket_stars, "a long, b long")


def candidates(classes: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root): components that hold every pair which shares a bucket within ``QUICK_BUDGET``, and the edges ``more``."""
    many = classes.count() > HOT
    first = _stars(classes.select(F.col("set").alias("name"), "sig"), slice(FIRST), many)
    first = materialise(connected_components(first.union(more)), "first")
    known = classes.join(broadcast_if(first, size_of(first), BROADCAST_BYTES), F.col("set") == F.col("node"), "left")
    rest = _stars(known.select(F.coalesce("root", "set").alias("name"), "sig"), slice(FIRST, LANES), many)
    return connected_components(rest.union(first.select("node", "root")))


def differing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words lie along the first axis."""
    return sum((np.bitwise_count(x ^ y) for x, y in zip(one, two, strict=True)), np.uint16(0))


def likely_pairs(one: np.ndarray, two: np.ndarray, sig: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) over places ``one`` and ``two`` of unlike labels that differ in at most ``BUDGET`` bits."""
    found = [(np.zeros(0, np.int64),) * 3]
    step = max(1, 200_000 // max(1, len(two)))
    other = np.ascontiguousarray(sig[two].T)
    for at in range(0, len(one), step):
        part = one[at : at + step]
        apart = differing(sig[part].T[:, :, None], other[:, None])
        i, j = np.nonzero((apart <= BUDGET) & (label[part, None] != label[two]))
        found.append((part[i], two[j], apart[i, j].astype(np.int64)))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def cell_pairs(side: np.ndarray, label: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likely pairs of a cell, most alike first: across its sides, or within the only one."""
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    i, j, apart = likely_pairs(one, two if side.any() else one, sig, label)
    keep = np.flatnonzero((i < j) | side.any())
    keep = keep[np.argsort(apart[keep], kind="stable")]
    return i[keep], j[keep]


def cell_links(side: np.ndarray, label: np.ndarray, sig: np.ndarray, has: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places (i, j) of similar pairs of a cell, enough to join what is similar."""
    i, j = cell_pairs(side, label, sig)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out, (p, q) = [], SIMILAR
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(int(label[a])), find(int(label[b]))
        if x != y and (p + q) * len(np.intersect1d(has[a], has[b], assume_unique=True)) >= p * (len(has[a]) + len(has[b])):
            root[x] = y
            out.append((a, b))
    return out


_CELL = ["key", "i", "j"]


def by_cell(solve):
    """A function over the partitions of a table sorted by cell, whole cells at a time, by ``solve`` (rows, their edges)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(x: pd.DataFrame) -> pd.DataFrame:
            x = x.reset_index(drop=True)
            edge = np.append(np.flatnonzero((x[_CELL].diff() != 0).any(axis=1).to_numpy()), len(x))
            return solve(x, list(zip(edge, edge[1:], strict=False)))

        held: pd.DataFrame | None = None
        for part in parts:
            if not len(part):
                continue
            x = part if held is None else pd.concat([held, part], ignore_index=True)
            last = (x[_CELL] == x[_CELL].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():
                yield solved(x[~last])
            held = x[last]
        if held is not None:
            yield solved(held)
        del held
        give_back()

    return run


@by_cell
def _needed(x: pd.DataFrame, cells: list[tuple[int, int]]) -> pd.DataFrame:
    """The rows of each cell that have a likely partner in it."""
    sig, label, side = _words(x["sig"]), *(x[c].to_numpy() for c in ("label", "side"))
    need = np.zeros(len(x), bool)
    for a, b in cells:
        for ends in cell_pairs(side[a:b], label[a:b], sig[a:b]):
            need[a + ends] = True
    return x[need]


@by_cell
def _cell_links(x: pd.DataFrame, cells: list[tuple[int, int]]) -> pd.DataFrame:
    """Links of the cells."""
    sig, sets, label, side = _words(x["sig"]), *(x[c].to_numpy() for c in ("set", "label", "side"))
    has = [np.frombuffer(h, "<i8") for h in x["has"]]
    found = [(a + i, a + j) for a, b in cells for i, j in cell_links(side[a:b], label[a:b], sig[a:b], has[a:b])]
    i, j = np.array(found, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": np.maximum(sets[i], sets[j]), "b": np.minimum(sets[i], sets[j])}).drop_duplicates()


def member_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, has): the shingle set itself, as sorted little-endian integers, of each of ``wanted`` (set, digest)."""

    @F.pandas_udf("binary")
    def members(texts: pd.Series) -> pd.Series:
        return pd.Series([np.sort(shingles(t).view(np.int64)).astype("<i8").tobytes() for t in texts])

    asked = materialise(wanted.select("set", F.col("digest").alias("d")), "asked")
    asked = broadcast_if(asked, size_of(asked), BROADCAST_BYTES)
    texts = docs.select("text", F.xxhash64("text").alias("digest")).join(asked, F.col("digest") == F.col("d")).groupBy("set").agg(F.min("text").alias("text"))
    return texts.select("set", members("text").alias("has"))


def similar(pairs: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct (a, b) of ``pairs`` whose ``sets`` are similar; fingerprints leave out most of the others first."""

    def ends(p: DataFrame, of: DataFrame, name: str) -> DataFrame:
        one, two = (of.select(F.col("set").alias(k), F.col(name).alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return p.join(one, "a").join(two, "b")

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(differing(_words(x).T, _words(y).T) <= BUDGET)

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = SIMILAR  # c / (m + n - c) >= p / q
        one, two = ([np.frombuffer(v, "<i8") for v in c] for c in (x, y))
        return pd.Series([(p + q) * len(np.intersect1d(a, b, assume_unique=True)) >= p * (len(a) + len(b)) for a, b in zip(one, two, strict=True)], dtype=bool)

    close = materialise(ends(pairs.distinct(), sigs, "sig").filter(likely("x", "y")).select("a", "b"), "close")
    # sets of unlike sizes can't be similar
    p, q = SIMILAR
    near = (q * F.octet_length("x") >= p * F.octet_length("y")) & (q * F.octet_length("y") >= p * F.octet_length("x"))
    return materialise(ends(close, sets, "has").filter(near).filter(alike("x", "y")).select("a", "b"), "similar")


def _labelled(groups: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups with the label of each class, open groups (k, major, n_major, n_minor)): those of more than one label."""
    roots = materialise(connected_components(linked), "roots")
    known = materialise(groups.join(roots, F.col("set") == F.col("node"), "left").select("set", "key", F.coalesce("root", "set").alias("label")), "labels")
    counts = known.groupBy(F.col("key").alias("k"), "label").agg(F.count(F.lit(1)).alias("n"))
    per_key = counts.groupBy("k").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    open_ = per_key.filter("labels > 1").select("k", F.col("m.label").alias("major"), F.col("m.n").alias("n_major"), (F.col("n") - F.col("m.n")).alias("n_minor"))
    return known, materialise(open_, "open")


def _dealt(rest: DataFrame) -> DataFrame:
    """Rows of open groups with their cells (i, j): blocks of the minor labels first, then those of the major one."""
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    c_minor, c_major = blocks(F.col("n_minor")), blocks(F.col("n_major"))
    rows = rest.withColumns({"minor": F.col("label") != F.col("major"), "c_minor": c_minor, "c_major": c_major})
    own = F.when(F.col("minor"), F.pmod(F.xxhash64("set"), F.col("c_minor"))).otherwise(F.col("c_minor") + F.pmod(F.xxhash64("set"), F.col("c_major"))).cast("int")
    rows = rows.withColumn("own", own)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = F.transform(F.sequence(F.lit(0), F.least(F.col("own"), F.col("c_minor") - 1)), lambda i: cell(i, F.col("own")))
    beyond = F.when(F.col("minor") & (F.col("own") + 1 < F.col("c_minor") + F.col("c_major")), F.transform(F.sequence(F.col("own") + 1, F.col("c_minor") + F.col("c_major") - 1), lambda j: cell(F.col("own"), j)))
    rows = rows.withColumn("cell", F.explode(F.concat(upto, F.coalesce(beyond, F.array().cast("array<struct<i:int,j:int>>")))))
    side = F.when(F.col("own") == F.col("cell.i"), 0).otherwise(1)
    return rows.select("key", "cell.i", "cell.j", side.alias("side"), "set", "label", "sig")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, root): rows of one root are one component of near copies."""
    prints = materialise(signatures(docs), "signatures")
    classes = materialise(prints.groupBy("set").agg(F.min("digest").alias("digest"), F.min("sig").alias("sig"), F.min("less").alias("less"), F.count(F.lit(1)).alias("n")), "classes")
    of_five = classes.filter(F.size("less") > 0).select(F.col("set").alias("a"), F.explode("less").alias("b"))
    of_five = materialise(of_five.join(classes.select(F.col("set").alias("b")), "b").select("a", "b"), "of-five")
    groups = materialise(candidates(classes, of_five).select(F.col("node").alias("set"), F.col("root").alias("key")), "groups")
    some = materialise(classes.join(broadcast_if(groups.select("set"), size_of(groups), BROADCAST_BYTES), "set").select("set", "digest", "sig"), "some")
    sigs, sets = some.select("set", "sig"), materialise(member_sets(docs, some.select("set", "digest")), "sets")
    linked = similar(groups.filter("set <> key").select(F.col("set").alias("a"), F.col("key").alias("b")), sigs, sets).union(of_five)
    for turn in range(ROUNDS + 1):
        known, open_ = _labelled(groups, linked)
        if open_.isEmpty():
            break
        rest = known.join(broadcast_if(open_, size_of(open_), BROADCAST_BYTES), F.col("key") == F.col("k"))
        if turn == ROUNDS:
            dealt = _dealt(rest.join(sigs, "set"))
            names = [f"{n} {t}" for n, t in dealt.dtypes]
            needed = materialise(dealt.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInPandas(_needed, ", ".join(names)), "needed")
            cells = needed.join(sets, "set").repartition(*_CELL).sortWithinPartitions(*_CELL)
            linked = linked.union(materialise(cells.mapInPandas(_cell_links, "a long, b long"), "linked"))
            break
        pivots = rest.filter("label = major").groupBy(F.col("key").alias("p")).agg(F.min_by("set", F.xxhash64("set", F.lit(turn))).alias("pivot"))
        pairs = rest.filter("label <> major").join(pivots, F.col("key") == F.col("p")).select(F.greatest("set", "pivot").alias("a"), F.least("set", "pivot").alias("b"))
        linked = linked.union(similar(pairs, sigs, sets))
    roots = materialise(connected_components(linked), "roots")
    named = materialise(classes.select("set", "n").join(roots, F.col("set") == F.col("node"), "left").select("set", "n", F.coalesce("root", "set").alias("root")), "named")
    return join_hot(prints.select("doc_id", "digest", "set"), named, "set", "n").select("doc_id", "digest", "root")
