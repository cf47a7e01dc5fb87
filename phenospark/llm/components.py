"""Connected components by alternating large-star and small-star steps.

Edges shrink to stars around the smallest node of each component. Each task first contracts the
edges it has by itself; the steps between tasks are group-bys with map-side combination and joins.
What a round leaves is written, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


class UnionFind:
    """The root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        r = x
        while (p := up.setdefault(r, r)) != r:
            r = p
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


#: Nodes that a task remembers while it contracts edges.
MOST_NODES = 200_000
#: What is left of edges is small; few files suffice.
FILES_PER_CORE = 2


def _contract(edges: DataFrame) -> DataFrame:
    """In each task, edges shrink to stars around the smallest node that the task knows of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds = UnionFind(), None

        def stars() -> Iterator[pa.RecordBatch]:
            pairs = [(x, r) for x in list(seen.up) if (r := seen.root(x)) != x]
            for i in range(0, len(pairs), 10_000):
                part = pairs[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], kinds[k]) for k in range(2)], names=["a", "b"])

        for batch in batches:
            kinds = [c.type for c in batch.columns]
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.join(a, b)
            if len(seen.up) >= MOST_NODES:
                yield from stars()
                seen = UnionFind()
        yield from stars()

    return edges.mapInArrow(run, edges.schema)


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) have a > b. Move each from b to the smallest neighbour of b, if that is smaller.

    The smallest neighbours are written first: then both sides of the join come from shuffles that
    Spark may split, as a hub is the smaller end of very many edges.
    """
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("hub"), "m"), "least", FILES_PER_CORE)
    return edges.join(least, F.col("b") == F.col("hub"), "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of each node, and the node, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one edge, and it leads to a node that has none."""
    again = edges.groupBy("a").count().filter("count > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
    return again.unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (columns ``a, b``) that isn't the smallest of its
    component; a node appears once. Edges may repeat, in either direction, and join a node to itself.
    No edges give no rows; edges with a null end are left out."""
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(_small_star(materialize(_contract(edges), "edges", FILES_PER_CORE)), "edges", FILES_PER_CORE)
    while not _are_stars(edges):
        before = edges
        edges = materialize(_small_star(_contract(_large_star(edges))), "edges", FILES_PER_CORE)
        discard(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
