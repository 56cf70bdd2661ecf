import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from loomkv.llm import common, decontaminate, language_id, packing, quality_model, secrets, simhash, tokens

SF = "/root/testdata/sf0.01"


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.text_lang == r.lang for r in got]) > 0.98 and np.mean([r.pred_lang == r.lang for r in got]) > 0.99 and np.mean([r.kept for r in got]) > 0.995


def test_language_evidence_and_edges(spark):
    words = {"en": "the house and the river with this thing", "de": "das Haus und der Fluss über nicht schön"}
    rows = [(i, words[x] * 4, x, f"a.{x}.net") for i in range(40) for x in words]
    odd = [(100, None, "de", "x.de"), (101, "", "de", "x.de"), (102, "123 456 !!", "en", "b.org"), (103, None, None, None), (104, "  ", None, "z.de"), (105, words["en"] * 20_000, None, None), (106, "xqzvkj" * 60 + " wvxzqk" * 40, None, "b.org"), (107, words["de"], "en", "x.de"), (107, words["de"], "en", "x.de"), (None, words["en"], "en", "b.org")]
    df = spark.createDataFrame([(*r, "s", 1.0) for r in rows + odd], "key long, text string, declared string, host string, prior string, mean double")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows + odd) and Counter(r.key for r in got)[107] == 2
    by = {r.key: r for r in got if r.key is None or r.key >= 100}
    assert not any(by[k].kept for k in (100, 101, 102, 103, 104, 106)) and by[105].kept and by[None].kept
    assert by[100].pred_lang == by[104].pred_lang == "de" and by[107].text_lang == "de"  # suffix and declaration stand in for the text
    assert language_id.identify(df.limit(0)).count() == 0
    none = language_id.identify(df.withColumn("declared", F.lit(None).cast("string")))
    assert none.count() == len(rows + odd)


def test_held_out_languages(spark):
    """Documents whose declaration is taken away teach nothing and are told by text and host alone."""
    out = quality_model.held_out(F.col("doc_id"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "right").withColumn("lang", F.when(~out, F.col("right")))
    got = language_id.identify_documents(docs).join(docs.filter(out).select("doc_id", "right"), "doc_id").collect()
    assert len(got) > 200 and np.mean([r.text_lang == r.right for r in got]) > 0.98 and np.mean([r.pred_lang == r.right for r in got]) > 0.98


def test_fusion_against_plain_python(spark):
    rng = np.random.default_rng(2)
    words = {"en": "the house and river with this thing".split(), "de": "das Haus und der Fluss schön nicht".split(), "fr": "la maison et le fleuve être".split()}
    hosts = ["a.x.de", "b.x.de", "www.y.org", "z.fr", "plain", None, "q.uk"]
    rows = []
    for i in range(120):
        x = ("en", "de", "fr")[i % 3]
        mixed = [*rng.choice(words[x], int(rng.integers(0, 9))), *rng.choice(words[("de", "fr", "en")[i % 3]], int(rng.integers(0, 6)))]
        rows.append((i, " ".join(mixed) or None, (x, None, "en")[int(rng.integers(3))], hosts[int(rng.integers(len(hosts)))]))
    df = spark.createDataFrame(rows, "key long, text string, declared string, host string")
    langs, logs = language_id.fit_text_models(df)
    priors = {r.p_host: r.prior for r in language_id.host_priors(df, langs).collect()}
    for r in language_id.identify(df).collect():
        _, text, declared, host = rows[r.key]
        c = language_id.codes(text) if text else []
        score = []
        for i, x in enumerate(langs):
            s = logs[c, i].astype(float).mean() * min(len(c), language_id.TEMPER) if len(c) else 0.0
            s += np.log(priors[host][i])
            if declared in langs:
                s += np.log(language_id.DECLARED_RIGHT if declared == x else (1 - language_id.DECLARED_RIGHT) / (len(langs) - 1))
            ending = language_id.SUFFIXES.get(host.rsplit(".", 1)[1]) if host and "." in host else None
            if ending in langs:
                s += np.log(language_id.SUFFIX_RIGHT if ending == x else (1 - language_id.SUFFIX_RIGHT) / (len(langs) - 1))
            score.append(s)
        p = np.exp(np.array(score) - max(score))
        assert r.pred_lang == langs[int(np.argmax(score))] and abs(r.confidence - p.max() / p.sum()) < 1e-4


def test_rare_languages_have_a_model(spark, monkeypatch):
    """However few its rows are beside the sample, a declared language is known; so is one of long texts only."""
    monkeypatch.setattr(language_id, "MODEL_ROWS", 20)
    rng = np.random.default_rng(4)
    words = {"en": "the house and river with this thing".split(), "fi": "talossa ymmärrämme hyvää yöllä järvellä kissat".split(), "cy": "llwyd ynghyd ddŵr gwybodaeth rhwng".split()}
    some = lambda x, n: " ".join(rng.choice(words[x], n))
    rows = [(i, f"{some('en', 30)} {i}", "en") for i in range(1500)] + [(2000 + i, some("fi", 30), "fi") for i in range(3)] + [(3000, some("cy", 9000), "cy"), (3001, None, "eu")]
    rows += [(4000, some("fi", 40), None), (4001, some("cy", 40), None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "key long, text string, declared string, host string")
    assert language_id.fit_text_models(df)[0] == ["cy", "en", "eu", "fi"]
    got = {r.key: r for r in language_id.identify(df).collect()}
    assert [(got[k].text_lang, got[k].pred_lang, got[k].kept) for k in (2000, 3000, 4000, 4001, 7)] == [(x, x, True) for x in ("fi", "cy", "fi", "cy", "en")]


def test_host_priors_are_smoothed_up_the_levels(spark):
    rows = [("a.x.org", "de")] * 30 + [("b.x.org", "en")] + [("c.y.org", "en")] * 69
    got = {r.p_host: r.prior for r in language_id.host_priors(spark.createDataFrame(rows, "host string, declared string"), ["de", "en"]).collect()}
    s, top = language_id.SMOOTHING, [31 / 102, 71 / 102]
    mid = [(30 + s * top[0]) / (31 + s), (1 + s * top[1]) / (31 + s)]
    assert np.allclose(got["b.x.org"], [s * mid[0] / (1 + s), (1 + s * mid[1]) / (1 + s)]) and np.allclose(got["a.x.org"][0], (30 + s * mid[0]) / (30 + s))


def test_page_evidence(spark):
    html = '<!DOCTYPE html><HTML class="a" lang="fr-CA"><head><script>the the</script></head><body><p>la maison</p></body></html>'
    pages = spark.createDataFrame([(1, "https://u@www.Example.fr:80/p?q", html), (2, None, None), (3, "plain.de", "<p>x</p>")], "page_id long, url string, html string")
    assert [r.h for r in pages.orderBy("page_id").select(language_id.host_of(F.col("url")).alias("h")).collect()] == ["www.example.fr", None, "plain.de"]
    got = {r.page_id: r for r in language_id.identify_pages(pages).collect()}
    assert got[1].pred_lang == "fr" and got[1].kept and not got[2].kept


def test_quality_held_out_accuracy():
    docs, labels = (pq.read_table(f"{SF}/{t}.parquet").to_pydict() for t in ("documents", "labels"))
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    rows = [(i, text[i], q) for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if text.get(i)]
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    weights, bias = quality_model.train([t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2], [q for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 != 2])
    right = 0
    for _, t, q in out:
        ids = quality_model.features(t)
        right += (weights[ids].mean() + bias >= np.log(0.7 / 0.3)) == (q == 1)
    assert len(out) > 60 and right / len(out) > 0.93


def test_features_are_of_characters():
    one, two = quality_model.features("ñandú über"), quality_model.features("ñandú über über")
    assert len(one) == 2 + (12 - 2) + (12 - 4) and (two == quality_model.REPEAT).sum() == 1 and not (one == quality_model.REPEAT).any()
    assert quality_model.features("a \n\tb").tolist() == quality_model.features(" a b ").tolist() and not len(quality_model.features(" \n "))


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = quality_model.fit(docs, labels)
    turned = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again, other = quality_model.fit(docs, turned)
    assert (weights == again).all() and bias == other
    changed, _ = quality_model.fit(docs, labels.withColumn("quality", 1 - F.col("quality")))
    assert (weights != changed).any()


def test_quality_rows(spark):
    rows = [(i, ("good words all around here " if i % 3 else "bad bad bad junk ") * (1 + i % 5), "x") for i in range(160)] + [(3, None, "x"), (3, "", "x"), (None, "good words", None), (999, "good " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(160)] + [(3, None, "x"), (None, 1, "x"), (5000, 1, "x")], "doc_id long, quality int, text string")
    got = quality_model.score(docs, quality_model.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    assert np.mean([(r.score > 0.6) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 160]) > 0.95
    assert quality_model.score(docs.limit(0), quality_model.fit(docs.limit(0), labels)).count() == 0
    assert {r.score for r in quality_model.score(docs.limit(5), quality_model.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    plain = lambda n: " ".join(f"{'abcdefghijk'[x % 11]}{'lmnopqrst'[x % 9]}e{'uvwxyz'[x % 6]}" for x in rng.integers(0, 590, n))
    item = plain(14)
    rows = [(i, plain(60)) for i in range(40)]
    rows += [(100, rows[3][1]), (2, rows[4][1] + " x"), (200, f"{plain(20)} {item} {plain(20)}"), (201, plain(30) + " token = abcdef123456 end"), (202, None), (203, "12 34"), (204, plain(3000)), (None, plain(40)), (None, plain(41)), (None, f"{plain(30)} {item}"), (7, plain(50))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2, "x", 3) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k long, digest long, pred_lang string, row int")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    step = {name: f for name, f in corpus_pipeline.STAGES}
    kept = common.materialise(step["language_id"](spark, docs, sf))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in rows if d not in (202, 203))
    once = common.materialise(step["near_duplicates"](spark, kept, sf))
    assert once.columns == docs.columns
    left, groups = once.collect(), {}
    for r in simhash.near_duplicates(kept).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    assert len(left) == len(groups) < len(rows) - 2
    assert {r.text for r in left} >= {t for d, t in rows if d is None} and sum(r.text == rows[3][1] for r in left) == 1 and sum(r.doc_id == 7 for r in left) == 2
    clean = common.materialise(step["decontamination"](spark, once, sf))
    assert {r.text for r in left} - {r.text for r in clean.collect()} == {t for _, t in rows if item in (t or "")} and clean.count() == len(left) - 2
    safe = common.materialise(step["secrets"](spark, clean, sf))
    texts = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == docs.columns and safe.count() == clean.count() and texts[201].text.endswith(" [SECRET] end") and texts[201].n_chars == len(texts[201].text)
    pieces = step["packing"](spark, safe, sf).collect()
    coder = tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert sum(r.length for r in pieces) == sum(len(coder.encode(pa.array([r.text], pa.string()))[0]) + 1 for r in safe.collect())
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(pieces)
