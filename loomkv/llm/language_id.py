"""Language identification by Bayesian evidence fusion.

The posterior of a language adds, in logs: the tempered likelihood of the text under byte-trigram models, the
declared language of the markup (right with probability ``DECLARED_RIGHT``), the address suffix, and the host's
prior.  Host priors come from one grouped count over all rows and are smoothed up the levels host, domain, all.
The languages are all that some row declares; each has a text model from a sample of its own texts, and takes a
column of 256 KB of the table of models.
A text is rejected when it has no letters, when evenly drawn trigrams explain it better than any language, or when
no language reaches half of the posterior.

Defined results: a null, empty or letterless text has the language of its other evidence and is rejected; a null
declaration or host adds nothing of its own; a language declared only by rows without text never wins by text; ties go to the first language in order; repeated rows return each for
itself; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.llm.common import give_back, join_hot, materialise, table

#: The text models share about so many declared texts, but each language has at least MODEL_EACH (or all it has).
MODEL_ROWS, MODEL_EACH = 3000, 100
#: Of a longer text, the model takes so many characters.
MODEL_CHARS = 50_000
BUCKETS = 1 << 16
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
#: Pseudo-counts that a level takes from the level above.
SMOOTHING = 20.0
#: Trigrams after which further text adds no more weight, and trigrams from which on a text can be noise.
TEMPER, NOISE_FROM = 60.0, 30
LEAST_CONFIDENCE = 0.5
_OTHER = bytes(x for x in range(128) if not chr(x).isalpha())
_LETTERS = bytes.maketrans(_OTHER, b" " * len(_OTHER))


def codes(text: str) -> np.ndarray:
    """Hash buckets of the byte trigrams of the lower-cased runs of letters, with a blank at either end of each."""
    runs = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    b = np.frombuffer(b" ".join([b"", *runs, b""]), np.uint8).astype(np.uint32)
    return ((b[:-2] * 73_856_093) ^ (b[1:-1] * 19_349_663) ^ (b[2:] * 83_492_791)) % BUCKETS


def host_of(url: Column) -> Column:
    """Host of an address, lower-case; a plain name is its own host."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")), url))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def fit_text_models(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [bucket, language]): all declared languages, each from a sample by hash."""
    good = rows.filter(F.col("declared").isNotNull()).select("declared", "text", F.xxhash64("text").alias("k"))
    has_text = F.coalesce(F.octet_length("text"), F.lit(0)) > 0
    found = materialise(good.groupBy(F.col("declared").alias("s_lang")).agg(F.approx_count_distinct(F.when(has_text, F.col("k"))).alias("texts")), "languages")
    langs = sorted(x[0] for x in found.select("s_lang").collect())
    each = max(MODEL_EACH, MODEL_ROWS // max(1, len(langs)))
    # copies share a hash, so a share of all hashes is that share of the distinct texts; small languages give all theirs
    share = F.when(F.col("texts") > 2 * each, each / F.col("texts")).otherwise(2.0)
    place = F.shiftrightunsigned("k", 11) / float(1 << 53)
    chosen = good.filter(has_text).join(found, F.col("declared") == F.col("s_lang")).filter(place < share)
    sample = chosen.groupBy("declared", "k").agg(F.min(F.substring("text", 1, MODEL_CHARS)).alias("text")).select("declared", "text")
    counts = np.full((BUCKETS, max(1, len(langs))), 0.3, np.float32)
    at = {x: i for i, x in enumerate(langs)}
    for lang, text in sample.toLocalIterator():
        counts[:, at[lang]] += np.bincount(codes(text), minlength=BUCKETS)
    seen = (counts > 0.5).any(0)
    logs = np.log(counts / counts.sum(0, dtype=np.float64)).astype(np.float32)
    logs[:, ~seen] = -np.log(BUCKETS) - 1e-3  # no text: just under the noise limit
    return langs, logs


def host_priors(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(p_host, n_rows, prior array over ``langs``): counts of declared languages smoothed by domain and by all rows."""
    one = [F.sum((F.col("declared") == x).cast("double")).alias(f"c{i}") for i, x in enumerate(langs)]
    names = [f"c{i}" for i in range(len(langs))]
    hosts = materialise(rows.groupBy("host").agg(*one, F.count(F.lit(1)).alias("n_rows")).na.fill(0.0, names).withColumn("domain", domain_of(F.col("host"))), "hosts")
    total = hosts.agg(*(F.sum(x) for x in names)).first()
    whole = sum(x or 0.0 for x in total)
    top = [((x or 0.0) + 1.0) / (whole + len(langs)) for x in total]
    domains = hosts.groupBy(F.col("domain").alias("d")).agg(*(F.sum(x).alias(f"d{x}") for x in names))
    n_d, n_h = sum(F.col(f"d{x}") for x in names), sum(F.col(x) for x in names)
    mid = [(F.col(f"dc{i}") + SMOOTHING * top[i]) / (n_d + SMOOTHING) for i in range(len(langs))]
    prior = F.array(*((F.col(f"c{i}") + SMOOTHING * mid[i]) / (n_h + SMOOTHING) for i in range(len(langs))))
    return hosts.join(domains, F.col("domain").eqNullSafe(F.col("d"))).select(F.col("host").alias("p_host"), "n_rows", prior.alias("prior"))


def identify(rows: DataFrame) -> DataFrame:
    """``rows`` (key, text, declared, host) to (key, pred_lang, confidence, text_lang, kept)."""
    langs, logs = fit_text_models(rows)
    if not langs:
        langs, logs = ["und"], np.zeros((BUCKETS, 1), np.float32)
    known = rows.sparkSession.sparkContext.broadcast(logs)
    n = len(langs)

    @F.pandas_udf("scores array<float>, mean float, n int, letters boolean")
    def likelihood(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table_ = known.value
        for part in texts:
            out = []
            for t in part:
                c = codes(t) if t else ()
                if not len(c):
                    out.append((np.zeros(n, np.float32), 0.0, 0, False))
                    continue
                total = np.zeros(n)
                for at in range(0, len(c), 1 << 18):
                    total += table_[c[at : at + (1 << 18)]].sum(0, dtype=np.float64)
                mean = total / len(c)
                out.append(((mean * min(len(c), TEMPER)).astype(np.float32), float(mean.max()), len(c), any(map(str.isalpha, t[:256])) or any(map(str.isalpha, t))))
            yield pd.DataFrame(out, columns=["scores", "mean", "n", "letters"])
        give_back()

    small = materialise(rows.select("key", "declared", "host", likelihood("text").alias("t")), "likelihood")
    named = lambda df, host: df.withColumn("loomkv_host", F.coalesce(host, F.lit("\0")))
    priors = materialise(named(host_priors(small.select("declared", "host"), langs), "p_host"), "priors")
    joined = join_hot(named(small, "host"), priors, "loomkv_host", "n_rows")
    suffix_table = F.create_map(*(y for k, v in SUFFIXES.items() for y in (F.lit(k), F.lit(v))))
    suffix = F.element_at(suffix_table, F.coalesce(F.when(F.instr("host", ".") > 0, F.lower(F.substring_index("host", ".", -1))), F.lit("")))

    def evidence(value: Column, lang: str, right: float) -> Column:
        wrong = (1.0 - right) / max(1, n - 1)
        among = value.isin(langs)
        return F.when(among & (value == lang), float(np.log(right))).when(among, float(np.log(wrong if n > 1 else right))).otherwise(0.0)

    joined = joined.withColumn("suffix_lang", suffix)
    parts = [
        F.get("t.scores", F.lit(i)).cast("double") + F.log(F.coalesce(F.get("prior", F.lit(i)), F.lit(1.0 / n))) + evidence(F.col("declared"), x, DECLARED_RIGHT) + evidence(F.col("suffix_lang"), x, SUFFIX_RIGHT)
        for i, x in enumerate(langs)
    ]
    scored = joined.withColumn("s", F.array(*parts)).withColumn("best", F.array_max("s"))
    weight = F.aggregate(F.transform("s", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*map(F.lit, langs))
    noise = (F.col("t.n") >= NOISE_FROM) & (F.col("t.mean") < -float(np.log(BUCKETS)))
    return scored.select(
        "key",
        F.get(names, (F.array_position("s", F.col("best")) - 1).cast("int")).alias("pred_lang"),
        (1.0 / weight).alias("confidence"),
        F.get(names, (F.array_position("t.scores", F.array_max("t.scores")) - 1).cast("int")).alias("text_lang"),
        (F.col("t.letters") & ~noise & (1.0 / weight >= LEAST_CONFIDENCE)).alias("kept"),
    )


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents: the declared language is ``lang``, the host is ``source``."""
    rows = docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("declared"), host_of(F.col("source")).alias("host"))
    return identify(rows).withColumnRenamed("key", "doc_id")


def identify_pages(pages: DataFrame) -> DataFrame:
    """Web pages: the declaration is the markup's lang attribute, the host that of the address."""
    html = F.coalesce("html", F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang=["']?([A-Za-z]{2})""", 1)), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    rows = pages.select(F.col("page_id").alias("key"), body.alias("text"), declared.alias("declared"), host_of(F.col("url")).alias("host"))
    return identify(rows).withColumnRenamed("key", "page_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"))
