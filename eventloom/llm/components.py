"""Connected components by alternating large-star and small-star steps.

Each step needs the least neighbour of every node (partially aggregated, so a
hub costs one row a task) and one equi-join that AQE can split. Edges are cut to
the shared folder after each round; the loop ends when a round changes nothing.
FEW edges or fewer are joined by one task instead, without a shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, drop

#: Edges that one task can hold; the steps below take any number.
FEW = 100_000


def _at_once(edges: DataFrame) -> DataFrame:
    """node, root of few edges between longs, by union-find in one task."""

    def run(batches):
        up: dict[int, int] = {}

        def find(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = sorted((find(up.setdefault(a, a)), find(up.setdefault(b, b))))
                up[y] = x
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def _star(pairs: DataFrame) -> DataFrame:
    """Hang the neighbours of each node a (all of them in column b) on the least of node and neighbours."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return pairs.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b); null ends and loops are left out."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if {kind for _, kind in edges.dtypes} == {"bigint"} and edges.count() <= FEW:
        return cut(_at_once(edges))
    edges = cut(edges.distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = _star(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old, edges = edges, cut(small)
        drop(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
