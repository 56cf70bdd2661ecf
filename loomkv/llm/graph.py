"""Connected components: union-find over parts of an edge table, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkv.llm.common import give_back, materialise

#: Edges that one task takes.  A table of more goes to several tasks, and steps over the whole table join their results.
PART_EDGES = 250_000


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each a and b in place; a label is its component's first place."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _part_roots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for the nodes of a partition of edges, by these edges alone."""
    held = [x for x in parts if len(x)]
    if held:
        x = pa.Table.from_batches(held)
        ends = [x.column(c).to_numpy() for c in ("a", "b")]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        label = np.arange(len(nodes))
        unite(label, at[: len(x)], at[len(x) :])
        yield from pa.Table.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"]).to_batches(10_000)
        del x, ends, nodes, at, label
    del held
    give_back()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge in ``edges`` (a, b), longs.

    Self-loops and repeated edges change nothing; an empty table gives an empty one.  Up to ``PART_EDGES`` edges are
    solved in one task, which costs the driver a few jobs where each step over the table costs it ten.  Of more, parts of
    that size are contracted to stars first.  Each step writes its edges to the shared folder; a step keeps one edge per
    node and neighbour, never pairs within a group.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    n_parts = -(-now.count() // PART_EDGES)
    if n_parts <= 1:
        return now.coalesce(1).mapInArrow(_part_roots, "node long, root long")
    stars = now.repartition(n_parts).mapInArrow(_part_roots, "node long, root long").filter("node <> root")
    now = materialise(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), "cc")
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(lowest, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(down, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("k", "m"))
        now = materialise(small.filter("a <> b").distinct(), "cc")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select("b", "b").distinct())
        seen = sign
