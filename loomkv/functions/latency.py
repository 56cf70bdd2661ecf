"""Latency histogram: 371 fixed buckets, percentiles as lower bounds of buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(us: Column) -> Column:
    u = F.greatest(F.floor(us), F.lit(0).cast("long"))
    div = lambda n: F.floor(u / n)
    return F.when(u < 100, u).when(u < 1000, 100 + div(10) - 10).when(u < 10_000, 190 + div(100) - 10).when(u < 100_000, 280 + div(1000) - 10).otherwise(370).cast("int")


def lower_bound_us(b: Column) -> Column:
    return F.when(b < 100, b).when(b < 190, (b - 90) * 10).when(b < 280, (b - 180) * 100).when(b < 370, (b - 270) * 1000).otherwise(100_000).cast("long")


def histogram(rows: DataFrame, us: str) -> DataFrame:
    return rows.groupBy(bucket(F.col(us)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(hist: DataFrame, points: list[float]) -> DataFrame:
    """(p, us) over a histogram of at most 371 rows."""
    upto = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = hist.withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(W.partitionBy()))
    picks = [F.min(F.when(F.col("cum") >= F.floor(F.col("total") * p), F.col("bucket"))).alias(f"b{i}") for i, p in enumerate(points)]
    rows = F.array(*(F.struct(F.lit(p).alias("p"), F.coalesce(lower_bound_us(F.col(f"b{i}")), F.lit(0).cast("long")).alias("us")) for i, p in enumerate(points)))
    return cum.agg(*picks).select(F.inline(rows))


def exact_percentiles(rows: DataFrame, value: str, points: list[float], parts: int = 4096, enough: int = 100_000) -> DataFrame:
    """One row with the exact discrete percentiles p0, p1, ... of ``value``, nulls and NaN left out.

    The range that holds the wanted rank is cut into ``parts`` and counted until it has at most ``enough`` distinct
    values or can't be cut; only then are its values grouped.  The driver sees ``parts`` counts a round.
    """
    rows = rows.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("v")).first()
    out = []
    for p in points:
        rank = max(1, math.ceil(p * n))
        a, b, before = low, high, 0
        while n and a < b:
            step = (b - a) / parts
            inside = rows.filter((F.col("v") >= a) & (F.col("v") <= b))
            if not (math.isfinite(step) and a + step > a):
                break
            part = F.least(F.floor((F.col("v") - a) / step), F.lit(parts - 1))
            counts = inside.groupBy(part.alias("part")).agg(F.count("v").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"), F.approx_count_distinct("v").alias("d")).orderBy("part").collect()
            for r in counts:
                if before + r.c >= rank:
                    break
                before += r.c
            a, b = r.a, r.b
            if r.d <= enough:
                break
        if n and a < b:
            inside = rows.filter((F.col("v") >= a) & (F.col("v") <= b)).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
            upto = inside.withColumn("upto", F.sum("c").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)))
            a = upto.filter(F.col("upto") >= rank - before).agg(F.min("v")).first()[0]
        out.append(a if n else None)
    return rows.sparkSession.createDataFrame([tuple(out)], ", ".join(f"p{i} double" for i in range(len(points))))
