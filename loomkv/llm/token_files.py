"""Token-id files: concatenated ids in blocks, document boundaries in Elias-Fano code.

A file is Parquet with one row per block: the ids of its documents one after another (in 16 bits where the whole
vocabulary fits, else in 32), the end of each document and the document ids, both in Elias-Fano code: low bits packed,
high bits in unary, and the place of every 256th set bit, from which ``select`` finds any value without a table of
offsets.  Parts are ranges of doc_id, blocks ascend within a part.  Readers take boundaries and ids through
``select`` alone.

Defined results: null and empty texts give the end id alone; null doc_ids come first; repeated doc_ids stay in
the order of their text's hash; an empty table gives no block; ids that don't fit the width are an error.  Further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.llm import tokens
from loomkv.llm.common import broadcast_if, give_back, parts_for, scratch, small_batches, table

BLOCK_IDS = 1 << 20
SAMPLE = 256
#: Writing files is a job of its own, so its workers may hold more pieces than those of a pipeline.
CACHE_PIECES = 500_000
_CODE = "{0}_bits int, {0}_low binary, {0}_high binary, {0}_samples binary"
BLOCK_SCHEMA = f"part int, block int, base long, n_docs long, n_nulls long, n_ids long, id_bytes int, first_doc long, ids binary, {_CODE.format('ends')}, {_CODE.format('docs')}"
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in BLOCK_SCHEMA.split(", ")]
#: The place of the n-th set bit of a byte.
_SELECT = np.array([[*(b for b in range(8) if x >> b & 1), *[8] * 8][:8] for x in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence of n values from 0 up to u, in about n * (2 + log2(u / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        width = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(width) & 1).astype(np.uint8).ravel()
        at = (values >> width) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, width, np.packbits(low, bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """Values of the given numbers: from the nearest sample on, bytes of the high bits are counted up to the set bit."""
        i = np.asarray(numbers, np.int64)
        if len(i) and not (i.min() >= 0 and i.max() < self.n):
            raise IndexError(numbers)
        at, left = self.samples[i // SAMPLE].astype(np.int64), i % SAMPLE
        byte = at >> 3
        # set bits of the sample's own byte that lie before it count as not yet passed
        left = left + np.bitwise_count(self.high[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)).astype(np.int64)
        on = np.arange(len(i))
        while len(on):
            have = np.bitwise_count(self.high[byte[on]]).astype(np.int64)
            on, have = on[left[on] >= have], have[left[on] >= have]
            left[on] -= have
            byte[on] += 1
        high = byte * 8 + _SELECT[self.high[byte], left] - i
        out = high << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= (self.low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << k
        return out


def id_width(vocabulary: int) -> int:
    """Bytes of an id."""
    return 2 if vocabulary <= 1 << 16 else 4


def _blocks(path: str, end_id: int, block_ids: int):
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path, CACHE_PIECES)
        width = id_width(max(coder.size, end_id + 1))
        part, number, base = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        docs: list[pa.Array] = []

        def block() -> pa.RecordBatch:
            nonlocal number, base, held, lengths, docs
            ids, ends = np.concatenate(held), np.cumsum(np.concatenate(lengths))
            if len(ids) and int(ids.max()) >> 8 * width:
                raise OverflowError(f"an id of {int(ids.max())} does not fit {width} bytes")
            named = pa.concat_arrays(docs)
            known = named.drop_null().to_numpy()
            first = int(known[0]) if len(known) else 0
            row = [part, number, base, len(ends), named.null_count, len(ids), width, first, ids.astype(f"<u{width}").tobytes(), *EliasFano.of(ends).parts(), *EliasFano.of(known - first).parts()]
            number, base, held, lengths, docs = number + 1, base + len(ids), [], [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], names=names)

        size = 0
        for rows in parts:
            for some in tokens.slices(rows):
                ids, counts = coder.encode(some.column("text"))
                ends = np.cumsum(counts + 1) - 1
                out = np.full(len(ids) + len(counts), end_id, np.uint32)
                inside = np.ones(len(out), bool)
                inside[ends] = False
                out[inside] = ids
                held.append(out)
                lengths.append(counts + 1)
                docs.append(some.column("doc_id"))
                size += len(out)
                if size >= block_ids:
                    yield block()
                    size = 0
        if held:
            yield block()
        give_back()

    return write


def write_token_files(docs: DataFrame, where: str, path: str, end_id: int = 2, parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write the token files of ``docs`` to ``where``: a range of doc_id per part, sorted within."""
    n = parts or parts_for(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(_blocks(path, end_id, block_ids), BLOCK_SCHEMA).write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(where)


def block_documents(x: dict) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, starts, ends, ids) of a block, boundaries and doc_ids by select."""
    code = lambda name, n: EliasFano(n, *(x[f"{name}_{y}"] for y in ("bits", "low", "high", "samples")))
    ends = code("ends", x["n_docs"]).select(np.arange(x["n_docs"]))
    named = x["n_docs"] - x["n_nulls"]
    docs = code("docs", named).select(np.arange(named)) + x["first_doc"]
    return [None] * x["n_nulls"] + docs.tolist(), np.concatenate(([0], ends[:-1])), ends, np.frombuffer(x["ids"], f"<u{x['id_bytes']}")


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in parts:
        for i in range(len(rows)):
            (x,) = rows.slice(i, 1).to_pylist()
            docs, starts, ends, ids = block_documents(x)
            ids = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [docs, starts + x["base"] + x["part_base"], ends - starts, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _READ.split(", ")])


def read_token_files(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from token files; start counts the ids of all documents before."""
    blocks = spark.read.parquet(where)
    # a row per part: bounded by the number of write tasks
    sizes = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    rows, base = [], 0
    for part, n in sizes:
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part int, part_base long")
    joined = blocks.join(broadcast_if(bases, len(rows), 200_000), "part")
    return joined.mapInArrow(_documents, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), where, tokens.tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, where)
