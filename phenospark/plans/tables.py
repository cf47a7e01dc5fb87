"""Stand-in tables: the operators' domain tables made from the driver's star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.functions import normalize as N


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as laboratory rows: user = entity, event type = drug, value = measurement."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    sign = F.when(F.col("event_id") % 5 == 0, ">").when(F.col("event_id") % 5 == 1, "<=").otherwise("=")
    sub = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 0)
    call = N.censored_call(F.col("value"), sign, F.lit(25.0), F.lit(50.0))
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
    return e.select("event_id", "user_id", "event_type", "value", sign.alias("sign"), sub.alias("submitted"), call.alias("rederived"), week.alias("year"))


MEASUREMENTS_SQL = """
m0 AS (SELECT event_id, user_id, event_type, value,
  CASE WHEN event_id % 5 = 0 THEN '>' WHEN event_id % 5 = 1 THEN '<=' ELSE '=' END AS sign,
  CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 END AS submitted,
  CAST((day(ts) - 1) // 7 AS INT) AS year FROM events),
m AS (SELECT *, CASE WHEN value IS NULL THEN NULL
  WHEN sign = '>' THEN CASE WHEN value >= 50 THEN 1 END
  WHEN sign = '<=' THEN CASE WHEN value <= 25 THEN 0 END
  WHEN value > 50 THEN 1 WHEN value <= 25 THEN 0 END AS rederived FROM m0)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a probability that is a fixed function of their size and label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    j = d.join(table(spark, sf_dir, "labels"), "doc_id")
    p = ((F.col("n_chars") * 7919) % 700 + 300 * F.col("quality")) / 1000.0
    return j.select("doc_id", "lang", "source", "n_chars", "toxic", F.col("quality").cast("int").alias("y"), p.cast("double").alias("p"), ((F.col("n_chars") * 31) % 100).cast("double").alias("distance"))


SCORED_SQL = """
scored AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic, CAST(l.quality AS INT) AS y,
  ((d.n_chars * 7919) % 700 + 300 * l.quality) / 1000.0::DOUBLE AS p, CAST((d.n_chars * 31) % 100 AS DOUBLE) AS distance
  FROM documents d JOIN labels l USING (doc_id))"""


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities, brands of what they shipped (large returned lots) as features."""
    l = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49 and l_returnflag = 'R'").select("l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return l.join(p, l.l_partkey == p.p_partkey).select("l_suppkey", "p_brand").distinct()


PRESENCE_SQL = """
presence AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_quantity >= 49 AND l_returnflag = 'R')"""

EDGE_COSINE = 0.35


def edges(spark: SparkSession, sf_dir: str, vectors: DataFrame | None = None, keep: Sequence[str] = (), apart: str | None = None) -> DataFrame:
    from phenospark.operators.similarity import cosine_edges

    return cosine_edges(table(spark, sf_dir, "embeddings") if vectors is None else vectors, "vec_id", "embedding", EDGE_COSINE, keep=keep, apart=apart)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer edges, with the same components."""
    from phenospark.operators.similarity import cosine_links

    return cosine_links(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", EDGE_COSINE)


EDGES_SQL = f"""
edges AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS cosine
  FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= {EDGE_COSINE})"""
