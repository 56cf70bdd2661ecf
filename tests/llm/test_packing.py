import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomkv.llm import packing, tokens


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5000), max_size=40))
def test_plan_holds_every_piece_once(histogram):
    used = Counter()
    for lengths, n in packing.plan(histogram, 64):
        assert n > 0 and sum(lengths) <= 64
        for k in lengths:
            used[k] += n
    assert used == histogram


def test_fit_is_the_least_squares_optimum():
    """The conditions of the optimum hold: no pattern in use can gain, and none out of use would."""
    rng = np.random.default_rng(8)
    histogram = {k: int(rng.integers(1, 400)) for k in range(1, 64, 2)}
    chosen = packing.patterns(sorted(histogram), 64)
    x = packing.fit(histogram, chosen, sweeps=4000)
    keys = {k: i for i, k in enumerate(histogram)}
    a = np.zeros((len(keys), len(chosen)))
    for j, p in enumerate(chosen):
        for k, m in Counter(p).items():
            a[keys[k], j] = m
    slope = a.T @ (a @ x - np.array(list(histogram.values())))
    assert (x >= 0).all() and slope.min() > -1.5 and np.abs(slope[x > 1]).max() < 1.5
    # the number of sweeps in use comes near that optimum
    loss = lambda x: float(((a @ x - np.array(list(histogram.values()))) ** 2).sum())
    assert loss(packing.fit(histogram, chosen)) < loss(x) + 0.01 * loss(np.zeros(len(chosen)))


def test_rows_alike_are_spread(spark):
    docs = spark.createDataFrame([(7, "the same words")] * 500 + [(None, None)] * 40, "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == 540 and max(r.offset + r.length for r in got) <= 1024
    assert packing.pack(packing.pieces(docs, tokens.tokenizer_path("byte_bpe_50k.json"))).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    histogram = Counter(np.clip(rng.lognormal(5.5, 0.8, 200_000), 1, 1023).astype(int).tolist())
    made = sum(n for _, n in packing.plan(histogram))
    assert made <= 1.01 * sum(k * v for k, v in histogram.items()) / 1024 + 1


def test_short_pieces_fill_sequences():
    # no packing needs fewer than the ids' share of the capacity, nor than the pieces over half of it
    for histogram in ({40: 10_000, 50: 10_000}, {k: 500 for k in range(5, 90)}, {700: 1000, 30: 9000, 20: 500}):
        made = sum(n for _, n in packing.plan(histogram))
        least = max(sum(k * v for k, v in histogram.items()) / 1024, sum(v for k, v in histogram.items() if k > 512))
        assert made <= 1.04 * least + 2


def test_pieces_and_places(spark):
    rows = [(i, "some words here " * (i * 37 % 900), "x") for i in range(120)] + [(3, None, "x"), (None, "", "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(docs).collect()
    coder = tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for d, t, _ in rows:
        ids = np.append(coder.encode(pa.array([t], pa.string()))[0], 2).astype("<u4").tobytes()
        n = len(ids) // 4
        cuts = [0, n] if n <= 1024 else sorted({0, *range(n, 0, -1024)})
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(d, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) * 1.05 + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0
