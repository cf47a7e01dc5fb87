"""Average linkage of vectors in rounds over tables.

A cluster is the mean of its unit vectors and its size: the mean distance of two clusters is 1 minus
the product of their means. In a round every cluster finds its nearest one, and those that are each
other's nearest merge. A merge never brings a cluster nearer to a third, so this gives the tree of
always merging the nearest pair, and a cluster with no other below the cut is done for good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.storage import discard, materialize

from . import graph, ordered, pivots
from .similarity import vector_average_linkage


def by_rounds(rows: DataFrame, group: str, node: str, vector: str, cut: float, tail: int = 5000, block: int = 2048) -> DataFrame:
    """``group, node, root``: the smallest node of the cluster of every row; clusters don't cross groups.

    Equal vectors of a group are one cluster from the start, however many they are. Rounds end when
    at most ``tail`` clusters can still merge: these are one task. Null vectors and those of length 0
    are clusters of their own. Nodes are different; a cut of 1 or more is an error.
    """
    if cut >= 1:
        raise ValueError("at a cut of 1 vectors that have nothing in common would merge")
    named = rows.select(F.col(group).alias("group"), F.col(node).alias("node"), F.col(vector).alias("vector"))
    units = materialize(pivots.unit_vectors(named.select(F.struct("group", "node").alias("at"), "vector"), "at", "vector").select("id.group", "id.node", "v"), "unit-vectors")
    # A group is known by a hash in what follows; two groups of one hash would have to be told apart.
    keyed = units.withColumn("g", F.xxhash64("group"))
    clusters = materialize(keyed.groupBy("g", "group", "v").agg(F.min("node").alias("id"), F.count(F.lit(1)).alias("size")), "clusters")
    if clusters.groupBy("g").agg(F.count_distinct(F.coalesce(F.to_json(F.struct("group")), F.lit(""))).alias("n")).filter("n > 1").head(1):
        raise ValueError("two groups have the same hash")
    own = keyed.join(clusters.select("g", "v", F.col("id").alias("first")), ["g", "v"]).select("group", "node", "first")
    active = clusters.select("id", "v", "g", "size")
    merges = []
    while active.count() > tail:
        near = materialize(pivots.nearest(active.select("id", "v", "g"), 1 - cut, block), "nearest")
        back = near.select(F.col("id").alias("best"), F.col("best").alias("id"))
        merged = materialize(near.join(back, ["id", "best"]).filter("id < best").select("id", "best"), "merges")
        if not merged.head(1):
            active = active.limit(0)
            break
        merges.append(merged)
        going = active.join(near.select("id"), "id", "left_semi")
        other = going.select(F.col("id").alias("best"), F.col("v").alias("w"), F.col("size").alias("more"))
        kept = going.join(merged.select(F.col("best").alias("id")), "id", "left_anti").join(merged, "id", "left").join(other, "best", "left")
        mean = F.zip_with("v", "w", lambda a, b: (a * F.col("size") + b * F.col("more")) / (F.col("size") + F.col("more")))
        before, active = active, materialize(
            kept.select("id", F.when(F.col("best").isNull(), F.col("v")).otherwise(mean).alias("v"), "g", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "clusters"
        )
        if len(merges) > 1:
            discard(before)
        discard(near)
    kind = dict(active.dtypes)["id"]

    def finish(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        found = vector_average_linkage(x, cut, t["size"].to_numpy())
        _, first = np.unique(found, return_index=True)
        return pa.table({"id": t["id"].take(pa.array(first[found])), "best": t["id"]})

    merges.append(active.groupBy("g").applyInArrow(finish, f"id {kind}, best {kind}").filter("id != best"))
    edges = merges[0]
    for more in merges[1:]:
        edges = edges.unionByName(more)
    roots = graph.connected_components(edges, "id", "best")
    found = own.join(roots.withColumnRenamed("node", "first"), "first", "left").select(F.struct("group", "node").alias("at"), F.coalesce("root", "first").alias("root"))
    out = named.join(found, F.struct("group", "node").eqNullSafe(F.col("at")), "left")
    return out.select(F.col("group").alias(group), F.col("node").alias("node"), F.coalesce("root", "node").alias("root"))


def numbered(found: DataFrame, group: str) -> DataFrame:
    """``group, node, cluster``: the clusters of a group by their root, from 0."""
    roots = ordered.prefix_sums(found.select(group, "root").distinct(), [F.col("root")], {"n": F.lit(1)}, [group])
    roots = roots.select(F.col(group).alias("__g"), F.col("root").alias("__r"), (F.col("n") - 1).cast("int").alias("cluster"))
    return found.join(roots, F.col(group).eqNullSafe(F.col("__g")) & (F.col("root") == F.col("__r"))).select(group, "node", "cluster")
