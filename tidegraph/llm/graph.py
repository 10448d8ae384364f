"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two aggregations and a join on small rows, then each partition contracts what edges it has;
files are in proportion to edges (each one that a task makes may start a process), and nothing is collected
but counts. The number of steps grows with the logarithm of the largest component.
Lineage is cut by written tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, tidy, written

#: Edges of a step's file, about; tables of fewer than EACH * PIECES edges have PIECES files at most.
EACH, PIECES = 2000, 8


def pieces(n: int) -> int:
    """Partitions for a table of ``n`` small rows."""
    return max(PIECES, -(-n // EACH))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) move to its minimum."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    moved = both.join(low, "a")
    out = moved.where(F.col("b") > F.col("a")) if large else moved
    out = out.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        out = out.unionByName(low.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def _local(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """The same components with fewer edges: each piece of ``most`` edges becomes stars around its smallest nodes."""

    def stars(a: list[int], b: list[int]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent[x]
            return root

        for x, y in zip(a, b, strict=True):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        ends = [(x, r) for x in list(parent) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            if len(a) >= most:
                yield stars(a, b)
                a, b = [], []
        if a:
            yield stars(a, b)

    return edges.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root`` (the component's smallest node) for every node that has an edge."""
    at = written(_local(edges.where("a <> b").coalesce(pieces(edges.count()))), "edges")
    mark, many = None, pieces(at.count())
    while True:
        was, at = at, written(_local(_star(_star(at, True), False).coalesce(many)), "edges")
        forget(was)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, many = now, pieces(now[0])
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
