"""Load-test reports: nested JSON files to rows, and the table of engines by CPU counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of a report; everything else in the file is skipped by the scan.
_PART = "struct<`Ops/sec`: double, `Hits/sec`: double, `Misses/sec`: double, `Average Latency`: double, `KB/sec`: double, `Percentile Latencies`: struct<`p50.00`: double, `p99.00`: double, `p99.90`: double>>"
SCHEMA = f"`ALL STATS` struct<Sets: {_PART}, Gets: {_PART}, Totals: {_PART}>"
NAME = r"([^/]+)_([0-9]+)c_bench\.json$"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(engine, cpus, kind, ops, hits, misses, latency_ms, kb, p50, p99, p999) of files ``<engine>_<n>c_bench.json``."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*_bench.json").json(path)
    name = F.col("_metadata.file_path")

    def part(kind: str) -> Column:
        at = F.col("ALL STATS")[kind]
        tail = at["Percentile Latencies"]
        return F.struct(
            F.lit(kind.lower()).alias("kind"), at["Ops/sec"].alias("ops"), at["Hits/sec"].alias("hits"), at["Misses/sec"].alias("misses"), at["Average Latency"].alias("latency_ms"),
            at["KB/sec"].alias("kb"), tail["p50.00"].alias("p50"), tail["p99.00"].alias("p99"), tail["p99.90"].alias("p999"),
        )

    rows = raw.select(F.regexp_extract(name, NAME, 1).alias("engine"), F.regexp_extract(name, NAME, 2).cast("int").alias("cpus"), F.explode(F.array(*map(part, ("Sets", "Gets", "Totals")))).alias("x"))
    return rows.select("engine", "cpus", "x.*")


def by_cpus(rows: DataFrame, value: str, cpus: list[int]) -> DataFrame:
    """An engine per row, a CPU count per column, 0.0 where a report is missing."""
    table = rows.groupBy("engine").pivot("cpus", cpus).agg(F.first(value, ignorenulls=True))
    return table.na.fill(0.0).orderBy("engine")
