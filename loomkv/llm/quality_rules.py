"""Quality rules with adaptive thresholds (DataFrame functions only).

Counts are taken per document in one pass over the words.  Five measures follow from them, as whole numbers: symbols,
upper-case letters and words equal to the word before, in millionths of what they are a share of; repeated lines
likewise; and the mean length of a word in thousandths.  A sketch of a measure is the number of texts in each bucket
of a relative error of 1/32 (the leading six binary digits of the value), so sketches merge by sums and need no random
bits.  Sketches of the rows that pass the base rule are built per language and source and merged upwards for groups
of under ``MIN_GROUP`` texts.  An upper limit lies ``SPREAD`` times the wider half of the middle range (from the first
to the third quartile) above the median, which a fourth of junk doesn't move; the lower limit of the word length lies
as far under it.  ``GUARD`` is the least upper limit, for ratios that are zero in three quarters of a group.  The
limits join the documents again on (lang, source); a document fails where its measure is beyond its limit by more than ``CHANCE`` standard errors (and a count
by more than one), so a lone repeat in a short text is no evidence.

Rows alike in language, source and all counts are one text in the sketches, so a mass of copies can't set the limits.

Defined results: null and empty texts have no words and fail the base rule; null lang or source is a group of
its own; repeated rows return each for itself; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkv.llm.common import bind, materialise, table

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_GROUP = 50
SPREAD = 6
CHANCE = 3.0
#: A measure: the count, what it is a share of, and units of a whole.
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1_000_000),
    "dup_lines": ("n_dup_lines", "n_lines", 1_000_000),
    "upper": ("n_upper", "word_chars", 1_000_000),
    "stutters": ("n_stutters", "n_words", 1_000_000),
    "word_length": ("word_chars", "n_words", 1000),
}
#: The least upper limit of a ratio, in its units.
GUARD = {"symbols": 5000, "dup_lines": 10_000, "upper": 5000, "stutters": 5000}
#: The measure with a lower limit too.
TWO_SIDED = "word_length"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutters")
#: Groups with over this share of all rows are joined by broadcast: at most as many as the number's inverse.
HOT_SHARE = 0.001


def _covered(places: Column, n: int) -> Column:
    """Places covered by [p, p + n) for ascending ``places``."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(places, i + 1), p + n) - p))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside windows of ``n`` words that occur twice or more; windows are told apart by 64-bit hashes."""

    def marked(h: Column) -> Column:
        pairs = F.array_sort(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("p")))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return bind(F.array_sort(F.transform(same, lambda x: x["p"])), lambda places: _covered(places, n))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bind(pairs, twice))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) < n, F.lit(0).cast("long")).otherwise(bind(hashes, marked))


def _stutters(words: Column) -> Column:
    """Words equal to the word before."""
    return F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts) per document row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_row = docs.select(
        "doc_id",
        "lang",
        "source",
        bind(F.array_remove(F.split(text, BLANKS), ""), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), _stutters(w).alias("n_stutters"))).alias("w"),
        (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    return per_row.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.n").alias("n_lines"), "n_upper", "w.n_stutters")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _value(x: str) -> Column:
    count, whole, units = MEASURES[x]
    return F.expr(f"{count} * {units} div greatest({whole}, 1)")


def sketches(passed: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): texts per bucket, each named by its least value."""
    texts = passed.select("lang", "source", *COUNTS).distinct()
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("measure"), _value(x).alias("v")) for x in MEASURES)))
    rows = texts.select("lang", "source", each.alias("m")).select("lang", "source", "m.measure", "m.v").withColumn("drop", F.expr("greatest(length(bin(v)) - 6, 0)"))
    return rows.groupBy("lang", "source", "measure", F.expr("shiftleft(shiftright(v, drop), drop)").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketches of all groups alike in ``keys``, added."""
    return sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, q): texts of a group and, by measure, the quartiles."""
    group = W.partitionBy(*keys, "measure")
    placed = sketch.withColumn("upto", F.sum("n").over(group.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("total", F.sum("n").over(group))

    def at(x: str) -> Column:
        points = (F.min(F.when((F.col("measure") == x) & (100 * F.col("upto") >= q * F.col("total")), F.col("value"))).alias(name) for name, q in (("low", 25), ("mid", 50), ("high", 75)))
        return F.struct(*points).alias(x)

    return placed.groupBy(*keys).agg(F.max("total").alias("n"), F.struct(*map(at, MEASURES)).alias("q"))


def limits(measured: DataFrame) -> DataFrame:
    """(g_lang, g_source, max_<measure>, min_word_length) of every group with a row that passes the base rule."""
    sketch = materialise(sketches(measured.filter(~base_failed())), "sketches")
    groups = quantiles(sketch, "lang", "source")
    langs = quantiles(merged(sketch, "lang"), "lang").withColumnsRenamed({"lang": "of_lang", "n": "lang_n", "q": "lang_q"})
    whole = quantiles(merged(sketch)).withColumnsRenamed({"n": "all_n", "q": "all_q"})
    # one row: the quantiles of all texts
    joined = groups.join(langs, F.col("lang").eqNullSafe(F.col("of_lang"))).join(F.broadcast(whole))
    q = F.when(F.col("n") >= MIN_GROUP, F.col("q")).when(F.col("lang_n") >= MIN_GROUP, F.col("lang_q")).otherwise(F.col("all_q"))
    joined = joined.withColumn("q", q)

    def reach(x: str) -> Column:
        at = F.col("q")[x]
        return F.greatest(SPREAD * F.greatest(at["high"] - at["mid"], at["mid"] - at["low"]), F.expr(f"q.{x}.mid div 4"))

    def upper(x: str) -> Column:
        at = F.col("q")[x]
        return F.greatest(at["mid"] + reach(x), F.lit(GUARD.get(x, 0)).cast("long")).alias(f"max_{x}")

    lower = F.col("q")[TWO_SIDED]["mid"] - reach(TWO_SIDED)
    return joined.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *map(upper, MEASURES), lower.alias(f"min_{TWO_SIDED}"))


def failed_rules() -> Column:
    """Names of the measures beyond their limits, of a row with counts and limits."""

    def share(x: str) -> Column:
        count, whole, units = MEASURES[x]
        explained = F.col(f"max_{x}") * F.greatest(whole, F.lit(1)) / F.lit(float(units))
        return F.col(count) > explained + CHANCE * F.sqrt(explained) + 1

    # the lengths of words vary by about half their mean
    error = CHANCE * 500 * F.sqrt(F.col("word_chars").cast("double") * F.col("word_chars") / F.greatest("n_words", F.lit(1))) / F.greatest("n_words", F.lit(1))
    length = _value(TWO_SIDED)
    odd = (length > F.col(f"max_{TWO_SIDED}") + error) | (length < F.col(f"min_{TWO_SIDED}") - error)
    rules = {x: share(x) for x in MEASURES if x != TWO_SIDED} | {TWO_SIDED: odd}
    return F.filter(F.array(*(F.when(c, F.lit(x)) for x, c in rules.items())), lambda x: x.isNotNull())


def apply_rules(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, kept and the failed measures of every document row."""
    measured = materialise(measures(docs), "measures")
    limit = materialise(limits(measured), "limits")
    sizes = materialise(measured.groupBy(F.col("lang").alias("s_lang"), F.col("source").alias("s_source")).agg(F.count(F.lit(1)).alias("rows")), "sizes")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    sized = limit.join(sizes, F.col("g_lang").eqNullSafe(F.col("s_lang")) & F.col("g_source").eqNullSafe(F.col("s_source"))).drop("s_lang", "s_source")
    # hot groups are few, so their limits may be sent to every task; what remains has no hot key
    named = ["lang", "source"]
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    hot = sized.filter(F.col("rows") > F.lit(HOT_SHARE * total))
    first = measured.join(F.broadcast(hot), same, "left").withColumn("held", F.col("rows").isNotNull())
    columns = [x for x in limit.columns if x not in ("g_lang", "g_source")]
    if sized.filter(F.col("rows") <= F.lit(HOT_SHARE * total)).isEmpty():
        joined = first
    else:
        cold = sized.filter(F.col("rows") <= F.lit(HOT_SHARE * total))
        rest = first.filter(~F.col("held")).select(*named, "doc_id", *COUNTS)
        joined = first.filter("held").select(*named, "doc_id", *COUNTS, *columns).unionByName(rest.join(cold, same, "left").select(*named, "doc_id", *COUNTS, *columns))
    failed = failed_rules()
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*out, base_failed().alias("base_failed"), (~base_failed() & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def _quantiles_sql(keys: str, source: str, mark: str) -> str:
    """Quartiles per measure of the merged sketches of ``source``."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {k}measure"
    points = ", ".join(f"min(CASE WHEN 100 * upto >= {q} * total THEN value END) AS {mark}{name}" for name, q in (("low", 25), ("mid", 50), ("high", 75)))
    return f"""SELECT {k}measure, max(total) AS {mark}n, {points} FROM (
  SELECT {k}measure, value, sum(n) OVER ({part} ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER ({part}) AS total
  FROM (SELECT {k}measure, value, sum(n)::BIGINT AS n FROM {source} GROUP BY ALL)) GROUP BY ALL"""


def _limits_sql() -> str:
    guard = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in GUARD.items()) + " ELSE 0 END"
    reach = f"greatest({SPREAD} * greatest(high - mid, mid - low), mid // 4)"
    pick = lambda x: f"CASE WHEN n >= {MIN_GROUP} THEN {x} WHEN lang_n >= {MIN_GROUP} THEN lang_{x} ELSE all_{x} END AS {x}"
    return f"""SELECT lang, source, measure, greatest(mid + {reach}, {guard}) AS most, mid - {reach} AS least
FROM (SELECT g.lang, g.source, measure, {pick('low')}, {pick('mid')}, {pick('high')} FROM g JOIN l USING (measure) JOIN a USING (measure) WHERE g.lang IS NOT DISTINCT FROM l.lang)"""


_WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_VALUES_SQL = " UNION ALL ".join(f"SELECT lang, source, '{x}' AS measure, {c} * {u} // greatest({w}, 1) AS v FROM t" for x, (c, w, u) in MEASURES.items())
_BEYOND_SQL = "CASE measure " + " ".join(
    f"WHEN '{x}' THEN {c} > most * greatest({w}, 1) / {u}::DOUBLE + {CHANCE} * sqrt(most * greatest({w}, 1) / {u}::DOUBLE) + 1" for x, (c, w, u) in MEASURES.items() if x != TWO_SIDED
)
_BEYOND_SQL += f" ELSE word_chars * 1000 // greatest(n_words, 1) > most + err OR word_chars * 1000 // greatest(n_words, 1) < least - err END"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS_SQL} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, i, hash(list_slice(w, i, i + {WINDOW - 1})) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
rep AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS x FROM (SELECT *, count(*) OVER (PARTITION BY r, h) AS c FROM p) WHERE c > 1) GROUP BY r),
m AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_upper, len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x))::BIGINT AS n_stutters FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {CHANCE} * 500 * sqrt(word_chars::DOUBLE * word_chars / greatest(n_words, 1)) / greatest(n_words, 1) AS err FROM m),
t AS (SELECT DISTINCT lang, source, {", ".join(COUNTS)} FROM b WHERE NOT base_failed),
v AS ({_VALUES_SQL}),
s AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS value, count(*) AS n FROM v GROUP BY ALL),
g AS ({_quantiles_sql("lang, source", "s", "")}), l AS ({_quantiles_sql("lang", "s", "lang_")}), a AS ({_quantiles_sql("", "s", "all_")}),
lim AS ({_limits_sql()}),
f AS (SELECT b.r, string_agg(measure, ',' ORDER BY list_position({list(MEASURES)}, measure)) AS failed FROM b JOIN lim ON b.lang IS NOT DISTINCT FROM lim.lang AND b.source IS NOT DISTINCT FROM lim.source WHERE {_BEYOND_SQL} GROUP BY b.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed FROM b LEFT JOIN f USING (r)
"""
