import numpy as np
import xxhash

from loomkv.llm import graph, simhash
from loomkv.llm.graph import connected_components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    up = {x: x for x in set(prints)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    every = sorted(up)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 4:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in every}


def test_fingerprint_matches_slow_one():
    texts = [None, "", " \n", "One", "one two", "A b C d", "É x é X y", "a b c d e " * 300, " ".join(f"w{i * 7919 % 1009}" for i in range(1500)), " ".join(f"w{i * 7919 % 100_003}" for i in range(140_000))]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_trie_finds_every_component():
    rng = np.random.default_rng(5)
    for _ in range(20):
        fp = rng.integers(0, 2**64, 12, dtype=np.uint64)
        for _ in range(150):
            x = fp[rng.integers(len(fp))]
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= np.uint64(1) << np.uint64(b)
            fp = np.append(fp, x)
        fp = np.unique(fp)
        label = np.arange(len(fp))
        a, r = simhash.trie_links(np.zeros(len(fp)), fp)
        label[a] = r
        want = slow_components(fp.tolist())
        groups = {}
        for x, l in zip(fp.tolist(), label.tolist(), strict=True):
            groups.setdefault(l, set()).add(want[x])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_query_rows_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(25)]
    rows = []
    for i in range(220):
        words = base[i % 25].split()
        for _ in range(i % 3):
            words[rng.integers(len(words))] = "new"
        rows.append((1000 - i, " ".join(words), "c"))
    rows += [(5, None, "c"), (6, "", "c"), (6, "", "c"), (None, "lonely text with no friend at all", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    prints = [slow_fingerprint(t) for _, t, _ in rows]
    comp = slow_components(prints)
    first = {}
    for (d, _, _), p in zip(rows, prints, strict=True):
        if d is not None:
            first[comp[p]] = min(d, first.get(comp[p], d))
    want = sorted((str(d), p, first.get(comp[p])) for (d, _, _), p in zip(rows, prints, strict=True))
    for hot in (20_000, 8):
        simhash_hot, simhash.links.__defaults__ = simhash.links.__defaults__, (4, hot)
        got = sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
        simhash.links.__defaults__ = simhash_hot
        assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_hot_buckets_split_within_themselves(spark, monkeypatch):
    def masks_of(parts):
        for x in parts:
            yield x[["mask", "key"]].set_axis(["a", "b"], axis=1)

    monkeypatch.setattr(simhash, "_bucket_links", masks_of)
    fps = [int(x) for x in np.random.default_rng(3).integers(0, 2**12, 400)]
    made = simhash.links(spark.createDataFrame([(x,) for x in set(fps)], "fp long"), 4, 8).collect()
    first = simhash._blocks(list(range(64)), 5)
    assert made and all(any((r.a & (2**64 - 1)) & f == f for f in first) for r in made)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(7, 7), (100, 90), (100, 90)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 100: 90}


def test_components_in_parts(spark, monkeypatch):
    """Random graphs, solved in one task and in parts of a few edges, against all nodes that can be reached."""
    rng = np.random.default_rng(17)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (130, 2))] + [(500 - i, 499 - i) for i in range(30)] + [(900, x) for x in range(600, 640)]
    up = {x: x for e in pairs if e[0] != e[1] for x in e}
    for _ in up:
        for a, b in pairs:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    for most in (graph.PART_EDGES, 7, 60):
        monkeypatch.setattr(graph, "PART_EDGES", most)
        rows = connected_components(edges).collect()
        assert len(rows) == len(up) and {r.node: r.root for r in rows} == up
        assert connected_components(edges.limit(0)).count() == 0


def test_components_take_few_jobs(spark):
    """Each job's plan, threads and broadcasts take memory of the driver."""
    spark.sparkContext.setJobGroup("components", "")
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    assert {r.root for r in connected_components(edges).collect()} == {0}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setJobGroup("others", "")
    assert 0 < len(jobs) <= 10
