"""Cumulative sums and order statistics over a whole table without a single-task window.

Rows are dealt by ranges of the order columns and written with the number of their range. Sums of
the ranges are few; each row then adds what stands before its range to a window within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenospark.storage import materialize


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums``: the sum over all rows of the group up to this one.

    ``order`` must be a total order within a group.
    """
    by = by or []
    cols = df.columns
    tmp = {f"__v_{k}": v for k, v in sums.items()}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns(tmp).repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "ordered")
    totals = dealt.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__t{c}") for c in tmp])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__g_{c}") for c in by], F.col("__part").alias("__of"), *[F.coalesce(F.sum(f"__t{c}").over(before), F.lit(0)).alias(f"__t{c}") for c in tmp])
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    joined = dealt.join(totals, same)
    within = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*cols, *[(F.sum(f"__v_{k}").over(within) + F.col(f"__t__v_{k}")).alias(k) for k in sums])


def order_statistics(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Distinct values with ``first`` and ``last``: their ranks from 1 in the group. Nulls are left out."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = prefix_sums(counted, [F.col(value)], {"last": F.col("__n")}, by)
    return ranked.select(*(by or []), value, (F.col("last") - F.col("__n") + 1).alias("first"), "last")


def linear_quantile(df: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """The exact quantile, interpolated linearly between ranks, as column ``quantile``."""
    by = by or []
    ranks = order_statistics(df, value, by)
    n = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    at = (F.col("__n") - 1) * F.lit(q)
    joined = ranks.join(F.broadcast(n), by) if by else ranks.crossJoin(F.broadcast(n))  # one row
    pick = lambda rank: F.max(F.when((F.col("first") <= rank) & (F.col("last") >= rank), F.col(value)))
    low = joined.groupBy(*by).agg(pick(F.floor(at) + 1).alias("lo"), pick(F.ceil(at) + 1).alias("hi"), F.max(at - F.floor(at)).alias("w"))
    return low.select(*by, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("quantile"))
