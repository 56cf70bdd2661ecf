import numpy as np

import corpus_pipeline
from loomkv.llm import near_copies, simhash


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def slow_groups(texts):
    sets, up = [slow_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def test_stage_keeps_one_of_each_group(spark):
    """Edited and extended copies down to a similarity of 0.8, some of them similar only through another."""
    rng = np.random.default_rng(12)
    base = [[f"w{x}" for x in rng.integers(0, 2000, 150)] for _ in range(12)]
    texts = []
    for i in range(160):
        words = list(base[i % 12])
        for _ in range(i % 5):
            words[rng.integers(len(words))] = f"new{i}"
        texts.append(" ".join(words + [f"end{x}" for x in rng.integers(0, 99, i % 4 * 6)]))
    texts += [None, "", "two words", "Two  words", texts[3]]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    want = slow_groups(texts)
    assert 20 < len(set(want)) < 120
    root = {r.doc_id: r.root for r in near_copies.near_copies(docs).collect()}
    assert len({(root[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(root.values()))
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == sorted(set(want))
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_cells_find_the_same(spark, monkeypatch):
    """Without rounds of pivots and with blocks of a few classes, every open bucket is compared in cells."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 2000, 120)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(1 + i % 7):
            words[rng.integers(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_groups(texts)
    for rounds, block in ((0, 4), (0, 2000), (1, 7)):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        monkeypatch.setattr(near_copies, "BLOCK", block)
        root = {r.doc_id: r.root for r in near_copies.near_copies(docs).collect()}
        assert len({(root[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(root.values()))


def test_shuffled_decisions_are_the_same(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {i // 3}" if i % 3 else f"other {i} {words[i:]}", "en" if i % 4 else None, f"s{i % 2}", 1) for i in range(40)]
    rows += [rows[0], rows[0], (None, rows[1][1], "en", "s0", 1), (None, None, None, None, 1), (None, None, None, None, 1), (77, "", "en", "s0", 1), (78, "password=hunter22 " + words, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest long")
    stages = [f for n, f in corpus_pipeline.STAGES if n in ("language_id", "near_duplicates", "secrets")]
    ask = lambda: [sorted(map(str, f(spark, docs, "").collect())) for f in stages]
    want = ask()
    assert all(0 < len(x) <= len(rows) for x in want) and len(want[1]) < 30 and "hunter22" not in "".join(want[2])
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(corpus_pipeline.secrets, "BROADCAST_BYTES", -1)
    assert ask() == want


def test_trie_of_long_fingerprints():
    """Buckets of fingerprints of three words, joined under a budget of 58 bits, against all pairs."""
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 2**64, (40, 3), dtype=np.uint64)
    for _ in range(160):
        x = fp[rng.integers(len(fp))].copy()
        for b in rng.choice(192, rng.integers(20, 80), replace=False):
            x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        fp = np.append(fp, x[None], axis=0)
    bucket = np.sort(rng.integers(0, 3, len(fp)))
    fp = fp[np.lexsort((*fp.T[::-1], bucket))]
    up = np.arange(len(fp))
    for i in range(len(fp)):
        for j in range(i):
            if bucket[i] == bucket[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 58:
                up[up == up[i]] = up[j]
    label = np.arange(len(fp))
    a, root = simhash.trie_links(bucket, fp, 58, 10)
    label[a] = root
    assert 100 < len(set(up.tolist())) < 180 and len(set(zip(up.tolist(), label.tolist(), strict=True))) == len(set(up.tolist())) == len(set(label.tolist()))


def test_fingerprints_bring_similar_pairs_together(spark, monkeypatch):
    """Pairs at 0.8 exactly, of 4 to 400 shingles, meet among the candidates; also where buckets are split into cells."""
    rng = np.random.default_rng(21)
    texts = []
    for i in range(240):
        shared = (4, 8, 12, 40, 320)[i % 5]
        words = [f"w{x}" for x in rng.integers(0, 10**6, shared + 4 + shared // 4)]
        texts += [" ".join(words[: shared + 4]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = near_copies.materialise(near_copies.signatures(docs))
    name = {r.doc_id: r.set for r in prints.collect()}
    classes = prints.select("set", "sig")
    tiny = spark.createDataFrame([(name[i + 1], x) for i in range(0, 480, 10) for x in [name[i]]], "a long, b long")
    for hot in (200_000, 1):
        monkeypatch.setattr(near_copies, "HOT", hot)
        root = {r.node: r.root for r in near_copies.candidates(classes, tiny).collect()}
        assert all(root[name[i]] == root[name[i + 1]] for i in range(0, 480, 2)) and len(set(root.values())) == 240
    less = {r.doc_id: r.less for r in prints.collect()}
    assert all(name[i] in less[i + 1] for i in range(0, 480, 10)) and not less[2]
    left = corpus_pipeline.keep_one_of_each_group(spark, docs.selectExpr("*", "'en' AS lang", "'s' AS source"), "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 480, 2))
