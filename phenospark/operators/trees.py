"""Scoring with forests kept as tables of nodes, without the library that fitted them.

A forest is rows ``model, tree, node, feature, threshold, left, right, value, features``. Entities
come as the sparse table of their features. A task holds the arrays of one model and walks all its
entities down all the trees together, one level a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.storage import scratch

#: Of one model; at 24 bytes each a task holds 120 MB at most.
MOST_NODES = 5_000_000


def forest_table(spark: SparkSession, model: PipelineModel | RandomForestClassificationModel, name: str, features: list[str]) -> DataFrame:
    """The nodes of a fitted forest: inner ones have a feature and go left up to the threshold, leaves
    have the share of class 1. Only numeric features."""
    forest = model.stages[-1] if isinstance(model, PipelineModel) else model
    path = scratch(spark, "forest")
    forest.write().save(path)
    n = F.col("nodeData")
    leaf = n["leftChild"] < 0
    names = F.array(*[F.lit(f) for f in features])
    stats = n["impurityStats"]
    return spark.read.parquet(f"{path}/data").select(
        F.lit(name).alias("model"), F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(~leaf, F.element_at(names, n["split"]["featureIndex"] + 1)).alias("feature"), F.when(~leaf, n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(~leaf, n["leftChild"]).alias("left"), F.when(~leaf, n["rightChild"]).alias("right"), F.when(leaf, stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)).alias("value"),
    )


class _Forest:
    """Arrays of all nodes of all trees; ``root`` is where each tree begins."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("tree", "ascending"), ("node", "ascending")])
        tree, node = rows["tree"].to_numpy(), rows["node"].to_numpy()
        key = tree.astype(np.int64) << 32 | node
        at = lambda c: np.searchsorted(key, tree.astype(np.int64) << 32 | rows[c].fill_null(0).to_numpy())
        inner = rows["feature"].is_valid().to_numpy()
        here = np.arange(len(key))
        self.left, self.right = np.where(inner, at("left"), here).astype(np.int32), np.where(inner, at("right"), here).astype(np.int32)
        if (key[self.left[inner]] & 0xFFFFFFFF != rows["left"].to_numpy(zero_copy_only=False)[inner]).any() or (key[self.right[inner]] & 0xFFFFFFFF != rows["right"].to_numpy(zero_copy_only=False)[inner]).any():
            raise ValueError("a tree names a node that it doesn't have")
        self.names = sorted({f for f in rows["feature"].unique().to_pylist() if f is not None})
        number = {f: i for i, f in enumerate(self.names)}
        self.feature = np.array([number.get(f, 0) for f in rows["feature"].to_pylist()], np.int32)
        self.threshold = np.where(inner, rows["threshold"].fill_null(0).to_numpy(), np.inf)
        self.value = rows["value"].fill_null(0).to_numpy()
        self.inner = inner
        self.root = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])).astype(np.int32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 of the leaves that each row of ``x`` (columns as ``names``) comes to."""
        at = np.tile(self.root, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while self.inner[at].any():
            below = x[row, self.feature[at]] <= self.threshold[at]
            at = np.where(below, self.left[at], self.right[at])
        return self.value[at].mean(1)


def forest_scores(long: DataFrame, entities: DataFrame, nodes: DataFrame, entity: str, feature: str, value: str | None = None) -> DataFrame:
    """``entity, model, p, n_used`` for every entity and model.

    ``long`` has the features that an entity has, with ``value`` or else 1; others are 0, and those
    that a model doesn't use are left out of ``n_used``. Of a feature given twice the largest value
    counts. Repeated entities have one row. Models are scored one after the other.
    """
    spark, kind = long.sparkSession, dict(entities.dtypes)[entity]
    amount = F.lit(1.0) if value is None else F.col(value).cast("double")
    sparse = long.groupBy(F.col(entity).alias("id"), F.col(feature).alias("f")).agg(F.max(amount).alias("v")).groupBy("id").agg(F.collect_list(F.struct("f", "v")).alias("has"))
    rows = entities.select(F.col(entity).alias("id")).distinct().join(sparse, "id", "left").select("id", F.coalesce("has", F.array().cast("array<struct<f:string,v:double>>")).alias("has"))
    out = spark.createDataFrame([], f"id {kind}, model string, p double, n_used long")
    for r in nodes.groupBy("model").count().orderBy("model").collect():  # a row for each model
        if r["count"] > MOST_NODES:
            raise ValueError(f"{r.model} has {r['count']} nodes, more than a task may hold")
        own = nodes.filter(F.col("model").eqNullSafe(r.model)).select("tree", "node", F.col("feature").cast("string").alias("feature"), "threshold", "left", "right", "value")
        shared = spark.sparkContext.broadcast(_Forest(own.toArrow()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, model=r.model) -> Iterator[pa.RecordBatch]:
            forest = shared.value
            number = {f: i for i, f in enumerate(forest.names)}
            rows_at_once = max(1, 2_000_000 // (len(forest.root) + len(forest.names) + 1))
            for b in batches:
                for s in range(0, b.num_rows, rows_at_once):
                    part = b.slice(s, rows_at_once)
                    x, used = np.zeros((part.num_rows, len(forest.names) + 1)), []
                    for i, has in enumerate(part.column(1).to_pylist()):
                        known = [(number[h["f"]], h["v"]) for h in has if h["f"] in number and h["v"] is not None]
                        for c, v in known:
                            x[i, c] = v
                        used.append(len(known))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model] * part.num_rows, pa.string()), pa.array(forest.scores(x)), pa.array(used, pa.int64())], names=["id", "model", "p", "n_used"])

        out = out.unionByName(rows.mapInArrow(run, f"id {kind}, model string, p double, n_used long"))
    return out.withColumnRenamed("id", entity)


def stored_scores(snapshot, wanted: DataFrame, nodes: DataFrame, entity: str, feature: str) -> DataFrame:
    """forest_scores() of the entities of ``wanted`` from a snapshot of sources.feature_store, with
    ``found``: an id that the store doesn't have gets no score and says so."""
    ids = wanted.select(entity).distinct()
    known = ids.join(snapshot.index.select(entity, F.lit(True).alias("found")), entity, "left")
    there = known.filter("found").select(entity)
    scored = forest_scores(snapshot.long.join(there, entity, "left_semi"), there, nodes, entity, feature)
    return known.join(scored, entity, "left").withColumn("found", F.coalesce("found", F.lit(False)))
