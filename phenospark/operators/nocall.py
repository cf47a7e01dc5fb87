"""When to abstain: conformal bands, distance rule, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions import constants as K
from phenospark.functions.scoring import prediction_set

from .ordered import linear_quantile, order_statistics


def _conformal(df: DataFrame, by: list[str], score: str, alpha: float) -> DataFrame:
    """The k-th smallest score, k = ceil((n + 1)(1 - alpha)), at most n."""
    ranks = order_statistics(df, score, by)
    n = ranks.groupBy(*by).agg(F.max("last").alias("__n")) if by else ranks.agg(F.max("last").alias("__n"))
    k = F.least(F.ceil((F.col("__n") + 1) * F.lit(1 - alpha)), F.col("__n"))
    j = ranks.join(F.broadcast(n), by) if by else ranks.crossJoin(F.broadcast(n))  # one row
    return j.filter((F.col("first") <= k) & (F.col("last") >= k)).select(*by, F.col(score).alias("q"))


def conformal_bands(cal: DataFrame, by: list[str], y: str = "y", p: str = "p", alpha_s: float = K.ALPHA_S, alpha_r: float = K.ALPHA_R) -> DataFrame:
    """``q_s, q_r, low, high`` per group; a group without both classes has no row."""
    s = _conformal(cal.filter(F.col(y) == 0).select(*by, F.col(p).alias("s")), by, "s", alpha_s).withColumnRenamed("q", "q_s")
    r = _conformal(cal.filter(F.col(y) == 1).select(*by, (1.0 - F.col(p)).alias("s")), by, "s", alpha_r).withColumnRenamed("q", "q_r")
    j = s.join(r, by) if by else s.crossJoin(F.broadcast(r))  # one row each
    edge = 1.0 - F.col("q_r")
    return j.select(*by, "q_s", "q_r", F.least("q_s", edge).alias("low"), F.greatest("q_s", edge).alias("high"))


def distance_threshold(df: DataFrame, distance: str, q: float = K.DISTANCE_QUANTILE, by: list[str] | None = None) -> DataFrame:
    return linear_quantile(df, distance, q, by)


def in_band(p: Column, q_s: Column, q_r: Column) -> Column:
    """No class or both are plausible."""
    return prediction_set(p, q_s, q_r).isin(0, 3)


def no_call(p: Column, q_s: Column, q_r: Column, distance: Column | None = None, threshold: Column | None = None) -> Column:
    if distance is None:
        return in_band(p, q_s, q_r)
    limit = F.when(threshold.isNull(), F.raise_error(F.lit("distances need a threshold")).cast("double")).otherwise(threshold)
    return in_band(p, q_s, q_r) | F.coalesce(distance > limit, F.lit(False))


def reason(p: Column, q_s: Column, q_r: Column, distance: Column, threshold: Column) -> Column:
    band, far = in_band(p, q_s, q_r), F.coalesce(distance > threshold, F.lit(False))
    return F.when(band & far, "conformal_band+ani_ood").when(band, "conformal_band").when(far, "ani_ood").otherwise("called")


def gate_override(p: Column, q_s: Column, q_r: Column, mask: Column, status: Column) -> Column:
    """Struct ``mask, flipped``: a susceptible call whose target can't be seen becomes a no-call."""
    flip = (prediction_set(p, q_s, q_r) == 1) & ~mask & (status == "not_callable")
    return F.struct((mask | flip).alias("mask"), flip.alias("flipped"))


BAND_FIELDS = ("q_s", "q_r", "low", "high", "alpha_s", "alpha_r", "distance_threshold")


def save_bands(bands: DataFrame, path: str, key: str = "drug") -> None:
    """Bands (and distance thresholds) as JSON lines, one a drug; what is there is replaced."""
    bands.select(key, *[F.col(c).cast("double").alias(c) if c in bands.columns else F.lit(None).cast("double").alias(c) for c in BAND_FIELDS]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_bands(spark, path: str, key: str = "drug") -> DataFrame:
    """What save_bands() wrote, number by number."""
    return spark.read.schema(f"{key} string, " + ", ".join(f"{c} double" for c in BAND_FIELDS)).json(path)


def gate_envelope(status: DataFrame, drug: str = "drug", genome: str = "genome_id") -> DataFrame:
    """``drug, value``: for each drug a JSON object from genome to gate status."""
    from phenospark.sources.writers import as_nested_json

    return as_nested_json(status, drug, genome, ["status"]).withColumnRenamed("key", drug)


def read_envelope(lines: DataFrame, drug: str = "drug", genome: str = "genome_id") -> DataFrame:
    """``drug, genome_id, status`` from gate_envelope()."""
    return lines.select(drug, F.explode(F.from_json("value", "map<string,struct<status:string>>")).alias(genome, "x")).select(drug, genome, "x.status")
