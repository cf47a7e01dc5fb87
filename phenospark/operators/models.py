"""Classifiers and calibration with pyspark.ml; each runs on a long table per drug."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``__w``: rows over twice the class's rows, so both classes weigh the same."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # two rows
    total = sum(counts.values())
    w = F.lit(1.0)
    for k, n in counts.items():
        w = F.when(F.col(label) == k, total / (len(counts) * n)).otherwise(w)
    return df.withColumn("__w", w)


def elastic_net(df: DataFrame, features: list[str], label: str, c: float = 1.0, l1_ratio: float = 0.5, rounds: int = 200) -> PipelineModel:
    """Scaled elastic-net logistic regression with balanced classes. A penalty of 1/C on a summed
    loss is 1/(C n) on a mean one."""
    rows = balanced_weights(df, label)
    n = rows.count()
    stages = [
        VectorAssembler(inputCols=features, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
        LogisticRegression(featuresCol="__x", labelCol=label, weightCol="__w", elasticNetParam=l1_ratio, regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=rounds),
    ]
    return Pipeline(stages=stages).fit(rows)


def random_forest(df: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 12, leaf: int = 5, seed: int = 0) -> PipelineModel:
    rows = balanced_weights(df, label)
    forest = RandomForestClassifier(featuresCol="__x", labelCol=label, weightCol="__w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), forest]).fit(rows)


def probability(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    keep = df.columns
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


def platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over the log-odds of a frozen model's score."""
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col(score)))
    x = df.select(F.log(q / (1 - q)).alias("z"), F.col(label).cast("double").alias("y"))
    m = LogisticRegression(featuresCol="__v", labelCol="y", regParam=0.0).fit(VectorAssembler(inputCols=["z"], outputCol="__v").transform(x))
    return float(m.coefficients[0]), float(m.intercept)


def apply_platt(df: DataFrame, score: str, slope: float, intercept: float, out: str = "p_calibrated") -> DataFrame:
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col(score)))
    return df.withColumn(out, 1 / (1 + F.exp(-(slope * F.log(q / (1 - q)) + intercept))))


def isotonic(df: DataFrame, score: str, label: str):
    return IsotonicRegression(featuresCol="__v", labelCol=label).fit(VectorAssembler(inputCols=[score], outputCol="__v").transform(df))


def apply_isotonic(model, df: DataFrame, score: str, out: str = "p_calibrated") -> DataFrame:
    keep = df.columns
    got = model.transform(VectorAssembler(inputCols=[score], outputCol="__v").transform(df))
    return got.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias(out))


def calibrate(cal: DataFrame, df: DataFrame, score: str, label: str, few: int = 25) -> DataFrame:
    """Isotonic with enough rows of both classes, logistic with fewer, the score itself without."""
    n = {r[label]: r["count"] for r in cal.groupBy(label).count().collect()}  # two rows
    if len(n) < 2:
        return df.withColumn("p_calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score))))
    if sum(n.values()) < few:
        return apply_platt(df, score, *platt(cal, score, label))
    return apply_isotonic(isotonic(cal, score, label), df, score)


def best_threshold(oof: DataFrame, p: str, y: str, points: int = 99) -> float:
    """The score on a grid of quantiles with the best balanced accuracy; the smallest of equals."""
    probs = [0.01 + i * 0.98 / (points - 1) for i in range(points)]
    grid = sorted(set(oof.select(F.percentile(p, F.array(*[F.lit(q) for q in probs])).alias("q")).first().q or []))
    if not grid:
        return 0.5
    t = F.explode(F.array(*[F.lit(g) for g in grid])).alias("t")
    # Each row is counted for all thresholds in its task; a few sums per threshold are shuffled.
    g = oof.select(F.col(p).alias("p"), F.col(y).alias("y"), t).groupBy("t").agg(F.avg(F.when(F.col("y") == 1, (F.col("p") >= F.col("t")).cast("double"))).alias("r"), F.avg(F.when(F.col("y") == 0, (F.col("p") < F.col("t")).cast("double"))).alias("s"))
    best = g.orderBy(((F.col("r") + F.col("s")) / 2).desc_nulls_last(), "t").first()
    return float(best.t)


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str = "fold", k: int = 5) -> DataFrame:
    """Probabilities of each fold by a model of the others; every row once, so a row outside the ``k``
    folds or a fold whose others lack a class is an error."""
    outside = df.filter(~F.coalesce(F.col(fold).between(0, k - 1), F.lit(False))).count()
    if outside:
        raise ValueError(f"{outside} rows are in none of the folds 0 to {k - 1}")
    held = {r[fold] for r in df.select(fold).distinct().collect()}  # at most k rows
    parts = []
    for i in sorted(held):
        rest = df.filter(F.col(fold) != i)
        if rest.select(label).distinct().count() < 2:
            raise ValueError(f"the rows outside fold {i} have fewer than two classes")
        parts.append(probability(elastic_net(rest, features, label), df.filter(F.col(fold) == i)))
    if not parts:
        return df.withColumn("p", F.lit(None).cast("double"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gap(df: DataFrame, features: list[str], label: str, random_part: str, grouped_part: str) -> tuple[DataFrame, DataFrame]:
    """Test rows with probabilities under a random and under a grouped split, for their difference."""
    one = probability(elastic_net(df.filter(F.col(random_part) == "train"), features, label), df.filter(F.col(random_part) == "test"))
    two = probability(elastic_net(df.filter(F.col(grouped_part) == "train"), features, label), df.filter(F.col(grouped_part) == "test"))
    return one, two
