from collections import Counter

import numpy as np

from loomkv.llm import sharding


def test_cuts_are_the_smallest_capacity(spark):
    rng = np.random.default_rng(1)
    for trial in range(3):
        h = rng.integers(-(2**63), 2**63 - 1, 3000)
        size = rng.integers(16, 5000, 3000)
        if trial == 1:
            h[:1000] = h[0]
        if trial == 2:
            h = h >> 48  # all under one prefix
            h[:700], h[700:900] = h[0], h[1]  # and two giants
        rows = spark.createDataFrame(list(zip(h.tolist(), size.tolist(), strict=True)), "h long, size long")
        cuts, capacity = sharding.cut_points(rows, 40)
        keys, at = np.unique(h, return_inverse=True)
        sums = np.bincount(at, size).astype(np.int64)
        assert capacity == sharding.smallest_capacity(sums, 40)
        load = np.bincount(np.searchsorted(cuts, h, "right"), size)
        assert len(load) == 40 and load.max() <= capacity
        giants = load > 1.5 * load.mean()
        assert giants.sum() == (0, 1, 2)[trial] and np.sort(load[~giants])[trial] > 0.9 * load[~giants].max()


def test_groups_slots_and_sizes(spark):
    rows = [(i, f"text {i % 90} " + "é" * (i % 50), 1) for i in range(900)] + [(1, None, 2), (2, None, 3), (None, "", 4), (5, "text", 5), (5, "text", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    got = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").encode()) + 16) for d, t, _ in rows)
    slots, crcs = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        crcs.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(40))
    assert sum(len(x) > 1 for x in crcs.values()) <= 1  # empty and null texts are two groups
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    """Every row is in one folder, equal texts in the same, among them a very long one; the shards are those of the slots."""
    rows = [(i, f"text {i % 40}" * (1 + i % 9)) for i in range(300)] + [(1, None), (2, ""), (3, "long " * 200_000), (4, "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(docs, f"file://{tmp_path}/s", shards=7)
    got = [(r.doc_id, r.text, r.shard) for r in spark.read.parquet(f"file://{tmp_path}/s").collect()]
    assert Counter((d, t) for d, t, _ in got) == Counter(rows)
    where = {}
    for _, t, s in got:
        where.setdefault(t, set()).add(s)
    assert all(len(x) == 1 for x in where.values()) and len({s for _, _, s in got}) <= 7
    assert Counter((d, s) for d, _, s in got) == Counter((r.doc_id, r.shard) for r in sharding.shard_documents(docs, 7).collect())
