"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two joins over the edges and is written to the shared folder. The edge count
never grows, and paths of length n end after about log n rounds. A node with very many
edges is aggregated on the map side first; the join back is an ordinary
equi-join, whose large partitions adaptive execution splits.

A graph of at most ``small`` distinct edges (counted first; 16 bytes each) is solved in one task by union-find, with
the same result and without rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    down = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(moved.select("a", F.col("m").alias("b"))).distinct()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) -> (node, root), the root being the smallest node of its component."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(a, b) with a <> b -> (node, root): every node that has an edge, with the smallest node it reaches."""
    edges = materialize(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    if edges.count() <= small:
        return edges.coalesce(1).mapInArrow(_union_find, "node long, root long")
    while True:
        many = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(1).alias("x"))
        deep = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi").select(F.lit(1).alias("x"))
        if many.union(deep).isEmpty():
            break
        edges = materialize(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
