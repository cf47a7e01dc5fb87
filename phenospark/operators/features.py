"""Presence features: long table, fixed-axis pivot, sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence_long(hits: DataFrame, entity: str, feature: str) -> DataFrame:
    return hits.select(entity, feature).filter(F.col(feature).isNotNull()).distinct()


def feature_axis(long: DataFrame, feature: str) -> list[str]:
    """The sorted features; a few thousand names at most are meant to be one axis."""
    return [r[0] for r in long.select(feature).distinct().orderBy(feature).collect()]


def presence_pivot(long: DataFrame, entity: str, feature: str, axis: list[str]) -> DataFrame:
    """A 0/1 column per feature of ``axis``: missing ones are 0, unknown ones are left out. Given the
    axis, the pivot is one aggregation without a job for its values."""
    return long.groupBy(entity).pivot(feature, axis).agg(F.max(F.lit(1))).fillna(0, subset=axis)


def catalog(hits: DataFrame, feature: str, order: str) -> DataFrame:
    """First hit of each feature in input order."""
    rest = [c for c in hits.columns if c not in (feature, order)]
    return hits.groupBy(feature).agg(F.min_by(F.struct(*rest), order).alias("x")).select(feature, *[F.col(f"x.{c}").alias(c) for c in rest])


def sparse_vectors(long: DataFrame, entity: str, feature: str, axis: list[str]) -> DataFrame:
    """``entity, size, indices``: positions of the entity's features on the axis."""
    spark = long.sparkSession
    dim = spark.createDataFrame(list(enumerate(axis)), "ix int, feature string")
    joined = long.withColumnRenamed(feature, "feature").join(dim, "feature")
    return joined.groupBy(entity).agg(F.sort_array(F.collect_set("ix")).alias("indices")).select(entity, F.lit(len(axis)).alias("size"), "indices")


def hit_counts(hits: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of several columns as ``column, value, n``, in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return hits.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def hits_by_entity(entities: DataFrame, hits: DataFrame, entity: str, kind: str, kinds: list[str]) -> DataFrame:
    """A row for each entity, those without a hit too: ``n_hits`` and ``n_`` of each kind."""
    g = hits.groupBy(entity).agg(F.count(F.lit(1)).alias("n_hits"), *[F.count(F.when(F.col(kind) == k, 1)).alias(f"n_{k}") for k in kinds])
    return entities.join(g, entity, "left").fillna(0, subset=["n_hits", *[f"n_{k}" for k in kinds]])


def top_weighted(long: DataFrame, weights: DataFrame, entity: str, feature: str, k: int, positive_after: bool = False) -> DataFrame:
    """The k features of each entity with the largest absolute weight (ties by name).

    With ``positive_after`` those without a positive weight go after the k have been chosen. An
    aggregate with a bounded state would serve as well; features of an entity are few.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(entity).orderBy(F.abs("weight").desc(), feature)
    top = long.join(weights, feature).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.filter("weight > 0") if positive_after else top
