"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.storage import materialize

#: Edges that a task contracts at once, and nodes that it remembers meanwhile.
CONTRACT_EDGES, CONTRACT_NODES = 1_000_000, 1_000_000


def link(to: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Puts the parts of x and y together; ``to`` has the root of each node, the smallest of its part."""
    while len(x):
        low, high = np.minimum(to[x], to[y]), np.maximum(to[x], to[y])
        apart = low != high
        x, y = x[apart], y[apart]
        np.minimum.at(to, high[apart], low[apart])  # the least of all: with any other a hub would take a round for each neighbour
        while (to[to] != to).any():
            to[:] = to[to]


def _star(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.Table:
    """The same components as stars: each node but one of a component with that one."""
    coded = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode()
    ends = coded.indices.to_numpy()
    to = np.arange(len(coded.dictionary))
    link(to, ends[: len(a)], ends[len(a) :])
    node = np.flatnonzero(to != np.arange(len(to)))
    return pa.table({"a": coded.dictionary.take(pa.array(node)), "b": coded.dictionary.take(pa.array(to[node]))})


def _contract(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars, so that no more of them leave it than it has nodes, however many pairs are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        fresh = 0
        for b in batches:
            held.append(b)
            fresh += b.num_rows
            if fresh >= CONTRACT_EDGES:
                star, fresh = pa.Table.from_batches(held), 0
                held = _star(star["a"], star["b"]).to_batches()
                if sum(h.num_rows for h in held) > CONTRACT_NODES:
                    yield from held
                    held = []
        if held:
            star = pa.Table.from_batches(held)
            yield from _star(star["a"], star["b"]).to_batches()

    return edges.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in edges.dtypes))


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (a, b) with a > b.

    First each edge moves from b to the smallest neighbour of b. Those are written before the join:
    a hub is the smaller end of very many edges, and Spark can split such a join only if both sides
    come straight from a shuffle. Then the smaller neighbours of a node join the smallest of them.
    """
    hubs = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("hub"), "m"), "hubs")
    large = edges.join(hubs, F.col("b") == F.col("hub"), "left").select("a", F.coalesce("m", "b").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None, node: str | None = None) -> DataFrame:
    """``node, root``: the smallest node that edges lead to. With ``nodes``, those without edges are their own.

    Each round halves distances to the roots; it ends when the edges are stars and stay the same.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    e = _contract(e)
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = mark(e)
    while last[0]:
        e = materialize(_stars(e), "edges")
        now = mark(e)
        if now == last:
            break
        last = now
    found = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if nodes is None:
        return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    ids = nodes.select(F.col(node).alias("node")).distinct()
    return ids.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def dense_cluster_ids(components: DataFrame) -> DataFrame:
    """``node, root, cluster_id``: clusters numbered from 0 by their smallest node."""
    from .ordered import prefix_sums

    roots = prefix_sums(components.select("root").distinct(), [F.col("root")], {"n": F.lit(1)})
    return components.join(roots.select("root", (F.col("n") - 1).alias("cluster_id")), "root").select("node", "root", "cluster_id")


def cluster_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
