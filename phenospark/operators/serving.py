"""Batch scoring of entities by drug models, reports, and what a service accepts and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions import scoring as S


def linear_scores(long: DataFrame, entities: DataFrame, weights: DataFrame, entity: str, feature: str) -> DataFrame:
    """``entity, drug, p, n_used`` of sparse 0/1 features under logistic models.

    ``weights``: ``drug, feature, coef, mean, std`` and an intercept as the row whose feature is null.
    Features that a model doesn't know are ignored, missing ones are 0. With z = b + sum(coef (x -
    mean) / std), only features that are present move z from the score of the empty entity, so the
    join touches what is present and nothing is densified.
    """
    k = F.when(F.col("std") > 0, F.col("coef") / F.col("std")).otherwise(0.0)
    empty = weights.groupBy("drug").agg(F.sum(F.when(F.col("feature").isNull(), F.col("coef")).otherwise(-k * F.col("mean"))).alias("z0"))
    steps = weights.filter(F.col("feature").isNotNull()).select("drug", F.col("feature").alias("__f"), k.alias("step"))
    moved = long.join(steps, F.col(feature) == F.col("__f")).groupBy(entity, "drug").agg(F.sum("step").alias("dz"), F.count(F.lit(1)).alias("n_used"))
    frame = entities.select(entity).distinct().crossJoin(F.broadcast(empty))  # one row a model
    z = F.col("z0") + F.coalesce("dz", F.lit(0.0))
    return frame.join(moved, [entity, "drug"], "left").select(entity, "drug", (1 / (1 + F.exp(-z))).alias("p"), F.coalesce("n_used", F.lit(0)).alias("n_used"))


def with_unscored(scores: DataFrame, entities: DataFrame, drugs: DataFrame, entity: str) -> DataFrame:
    """A row for every entity and drug of ``drugs`` (drug, skip): those without a model say why."""
    frame = entities.select(entity).distinct().crossJoin(F.broadcast(drugs))  # the panel's drugs
    j = frame.join(scores, [entity, "drug"], "left")
    return j.withColumn("skip", F.when(F.col("p").isNull(), F.coalesce("skip", F.lit("model_not_trained"))))


def evidence_counts(rows: DataFrame, hits: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Each verdict row with ``n_curated`` and ``n_model``: curated hits and model features that speak for it."""
    a = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_curated"))
    b = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_model"))
    return rows.join(a, keys, "left").join(b, keys, "left").fillna(0, subset=["n_curated", "n_model"])


def reports(rows: DataFrame, entity: str, drug: str, fields: list[str]) -> DataFrame:
    """One row per entity: ``drugs``, its drugs in order with their fields."""
    return rows.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(drug, *fields))).alias("drugs"))


def pick(rows: DataFrame, rankings: list[tuple[str, Column, list[Column]]]) -> DataFrame:
    """``slot`` and the first row of each ranking (name, condition, order); a slot without rows has none."""
    out = None
    for name, keep, order in rankings:
        top = rows.filter(keep).orderBy(*order).limit(1).select(F.lit(name).alias("slot"), "*")
        out = top if out is None else out.unionByName(top)
    return out


def first_choice(rows: DataFrame, name: str, choices: list[tuple[Column, list[Column]]]) -> DataFrame:
    """The first row of the first ranking that has any."""
    ranked = pick(rows, [(f"{i:03d}", keep, order) for i, (keep, order) in enumerate(choices)])
    return ranked.orderBy("slot").limit(1).withColumn("slot", F.lit(name))


def pending_first(jobs: DataFrame, done: DataFrame, key: str, most: int) -> DataFrame:
    """The next ``most`` jobs: those not done yet come first, by key."""
    mark = done.select(F.col(key).alias("__k")).distinct()
    return jobs.join(mark, F.col(key) == F.col("__k"), "left").withColumn("pending", F.col("__k").isNull()).drop("__k").orderBy(F.desc("pending"), key).limit(most)


RESPONSE = "score double, confidence double, classification string, evidence string, modelVersion string, model_version string, noCall boolean, detectedGenes array<struct<symbol:string,name:string,tier:string,confidence:string>>"
CLASSIFICATIONS = ("likely_effective", "uncertain", "likely_ineffective")


def parse_response(c: Column, most_genes: int = 50, model: str = "unknown") -> Column:
    """Struct of a service's JSON answer with defaults filled in; ``valid`` says whether it may be stored."""
    x = F.from_json(c, RESPONSE)
    prob = lambda v: v.isNotNull() & (v >= 0) & (v <= 1)
    sure = F.coalesce(x["confidence"], F.greatest(x["score"], 1 - x["score"]))
    known = x["classification"].isin(*CLASSIFICATIONS)
    ok = F.coalesce(prob(x["score"]) & prob(sure) & known, F.lit(False))
    evid = F.when(x["evidence"].isin("known_marker", "no_known_signal"), x["evidence"]).otherwise("statistical_association")
    genes = F.slice(F.coalesce(x["detectedGenes"], F.array().cast("array<struct<symbol:string,name:string,tier:string,confidence:string>>")), 1, most_genes)
    return F.struct(
        ok.alias("valid"), x["score"].alias("score"), sure.alias("confidence"), x["classification"].alias("classification"), evid.alias("evidence"),
        F.coalesce(x["modelVersion"], x["model_version"], F.lit(model)).alias("model_version"), F.coalesce(x["noCall"], x["classification"] == "uncertain").alias("no_call"), genes.alias("genes"),
    )


def verdict_rows(scores: DataFrame, bands: DataFrame, distance: DataFrame, entity: str) -> DataFrame:
    """Scores with the band of their drug and the distance of their entity: verdict and reason.

    ``bands``: drug, q_s, q_r, threshold. The panel's bands are few and are broadcast by their size.
    """
    j = scores.join(bands, "drug").join(distance.select(entity, "distance"), entity, "left")
    v = S.verdict_by_set(F.col("p"), F.col("q_s"), F.col("q_r"), F.col("distance"), F.col("threshold"))
    why = F.when(F.col("distance") > F.col("threshold"), "distance").when(v == S.NO_CALL, "band")
    return j.withColumn("verdict", v).withColumn("reason", why)
