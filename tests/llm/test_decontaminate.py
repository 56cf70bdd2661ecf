import hashlib
import re

import numpy as np

from loomkv.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow(docs, items, n=10):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            x = words(x)
            k = min(n, len(x))
            for a in range(len(x) - k + 1 if x else 0):
                for at in range(len(w) - k + 1):
                    if w[at : at + k] == x[a : a + k]:
                        hit |= set(range(at, at + k))
                        found.add(i)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((str(d), len(w), len(hit), len(found - {None}), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_rows_against_brute_force(spark):
    rng = np.random.default_rng(4)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 30, n))
    items = [(i, make(int(rng.integers(1, 25)))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "same same same same same same same same same same same same"), (14, "w1, W2!"), (15, "É ñ x1"), (3, items[3][1]), (None, "only here")]
    docs = [(i, make(int(rng.integers(0, 60)))) for i in range(40)]
    for i in range(30):
        x = items[int(rng.integers(12))][1].split()
        cut = x[int(rng.integers(0, 3)) :]
        docs.append((100 + i, f"{make(5)} {' '.join(cut).upper()} {make(5)}, {' '.join(cut)}"))
    docs += [(1, docs[0][1]), (0, docs[0][1]), (None, items[0][1]), (None, None), (200, ""), (201, None), (202, "same " * 300), (203, "É ñ, x1 é ñ x1"), (204, "w1 w2"), (205, "Only\0here"), (206, f"{'zz ' * 70_000}{items[0][1]}")]
    df = spark.createDataFrame([(d, t, 1, "x", d) for d, t in docs], "doc_id long, text string, shift int, item string, item_id long")
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(df, bench).collect())
    assert got == slow(docs, items)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    clean = decontaminate.contamination(df, bench.limit(0))
    assert clean.count() == len(docs) and clean.filter("contaminated").count() == 0


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 7} b c d e f g h i j k{i % 5} l m") for i in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a3 b c d e f g h i j"), (2, "b c d e f g h i j k2 l"), (3, "c d e f g h i j k9 l")], "item_id long, text string")
    ask = lambda: sorted(map(tuple, decontaminate.contamination(docs, bench).drop("hits").collect()))
    want = ask()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert ask() == want and sum(r[-1] for r in want) > 0


def slow_spans(docs, queries, within):
    out = set()
    for d, t in docs:
        w = words(t)
        for q, terms in queries:
            for end in range(len(w)):
                places = [[i for i in range(end + 1) if w[i] == x] for x in set(terms or ())]
                if places and w[end] in terms and all(places) and end - (start := min(p[-1] for p in places)) < within:
                    out.add((str(d), t, q, start, end))
    return sorted(out)


def test_proximity_against_brute_force(spark):
    """Rows that share an id or have none stay apart; columns of clashing names, nulls, empty and long texts."""
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"W{x}" for x in rng.integers(0, 25, 60))) for i in range(25)]
    docs += [(1, "alpha x"), (1, "y beta"), (None, "alpha z"), (None, "z beta"), (None, "alpha beta alpha"), (30, None), (31, ""), (32, "zz " * 70_000 + "alpha, Beta"), (1, "alpha x")]
    queries = [("ab", ["alpha", "beta"]), ("one", ["w3"]), ("two", ["w1", "w2"]), ("three", ["w4", "w5", "w6"]), ("same", ["w7", "w7"]), ("none", []), ("null", None), ("absent", ["w1", "nowhere"])]
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in docs], "doc_id long, text string, pos int, term string, query string")
    ask = spark.createDataFrame(queries, "query string, terms array<string>")
    digest = {r.h: r.text for r in df.select("text", decontaminate.F.xxhash64("text").alias("h")).collect()}
    for within in (1, 4, 30):
        got = sorted((str(r.doc_id), digest[r.digest], r.query, r.start, r.end) for r in decontaminate.proximity_search(df, ask, within).collect())
        short = [(d, t if t is None or len(t) < 10_000 else None) for d, t in docs]
        assert [x for x in got if len(x[1]) < 10_000] == slow_spans(short, queries, within)
        assert [x[2:] for x in got if len(x[1]) >= 10_000] == ([("ab", 70_000, 70_001)] if within > 1 else [])
    assert decontaminate.proximity_search(df.limit(0), ask, 3).count() == decontaminate.proximity_search(df, ask.limit(0), 3).count() == 0


def test_rarest_terms(spark):
    docs = spark.createDataFrame([(1, "a a a b b c d"), (2, "a d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "A b c, d"), (2, "nowhere a"), (None, "a"), (3, None)], "item_id long, text string")
    assert {r.query: r.terms for r in decontaminate.rarest_terms(docs, bench).collect()} == {1: ["b", "c", "d"], 2: ["a"]}
