"""Connected components of an edge table: union-find in tasks, stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardedlake.session import materialise

EDGE = "a long, b long"
LIMIT = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the smallest node, block by block, so that memory stays bounded."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def stars() -> pa.RecordBatch:
        rows = [(root(x), x) for x in list(parent) if root(x) != x]
        both = np.array(rows, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > LIMIT:
            yield stars()
            parent.clear()
    yield stars()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of the edges (a, b); a component is named by its smallest node.

    Large and small stars by turns: each node points at the smallest it has heard of,
    until nothing changes. Both are group-wise minima, combined before the shuffle, so
    a hub of any degree is no bottleneck. Each round is a written table.
    """
    at = materialise(edges.where("a <> b").select("a", "b").mapInArrow(_forest, EDGE).distinct(), "components")
    mark = None
    while True:
        # Large star: larger neighbours of a node point at the smallest around it.
        both = at.select("a", "b").union(at.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: a node and its smaller neighbours point at the smallest of them.
        lows = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lows, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        at = materialise(small, "components")
        now = at.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    return at.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(at.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
