"""One model per drug: rows, skip rules, fit, calibration or its fallback, bands, scores, saved bundles.

Drugs are few, so the loop over them is the driver's; what each step reads is the drug's rows, and what
reaches the driver are counts, a threshold or a model.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from urllib.parse import quote

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.functions import constants as K
from phenospark.functions.scoring import logit_shift

from . import labels, models, nocall, splits

#: With fewer resistant calibration rows, scores are only shifted.
LEAST_CALIBRATION_R = 5


@dataclass
class DrugModel:
    """``method`` is platt (slope, intercept) or shift (tau)."""

    drug: str
    features: list[str]
    model: PipelineModel
    method: str
    slope: float | None = None
    intercept: float | None = None
    tau: float | None = None
    q_s: float | None = None
    q_r: float | None = None
    distance_threshold: float | None = None
    counts: dict[str, int] = field(default_factory=dict)

    def meta(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "model"}

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``raw``, ``p``, ``no_call`` and ``reason``; ``distance`` is used where it is there."""
        raw = models.probability(self.model, rows, "raw")
        out = models.apply_platt(raw, "raw", self.slope, self.intercept, "p") if self.method == "platt" else raw.withColumn("p", logit_shift(F.col("raw"), F.lit(self.tau)))
        far = F.col("distance") if "distance" in rows.columns and self.distance_threshold is not None else F.lit(None).cast("double")
        limit = F.lit(self.distance_threshold).cast("double")
        reason = nocall.reason(F.col("p"), F.lit(self.q_s), F.lit(self.q_r), far, limit)
        return out.withColumn("reason", reason).withColumn("no_call", F.col("reason") != "called")


def training_rows(label_rows: DataFrame, features: DataFrame, split_rows: DataFrame, entity: str, drug: str, position: str) -> DataFrame:
    """Labels with features, split and cluster: of repeated labels of an entity and drug the first by
    ``position`` counts; entities without features or a split have no row."""
    first = labels.keep_first(label_rows, [drug, entity], [F.col(position)])
    return first.join(features, entity).join(split_rows, entity)


def split_counts(rows: DataFrame, by: str, y: str = "y", split: str = "split") -> DataFrame:
    """A row per drug: ``n, n_r, n_s`` in all and of each split."""
    n = lambda c: F.count(F.when(c, 1))
    parts = [("", F.lit(True))] + [(f"_{s}", F.col(split) == s) for s in ("train", "calibration", "test", "heldout_group")]
    return rows.groupBy(by).agg(*[n(c & ok).alias(f"{k}{name}") for name, c in parts for k, ok in (("n", F.lit(True)), ("n_r", F.col(y) == 1), ("n_s", F.col(y) == 0))])


def why_skipped(counts) -> str | None:
    """Of a row of split_counts(): nothing to train with, or nothing to calibrate with."""
    c = counts
    if not c["n_r_train"] or not c["n_s_train"]:
        return "single_class_training"
    if not c["n_r_calibration"] or not c["n_s_calibration"]:
        return "calibration_missing_or_single_class"
    return None


def train_drug(rows: DataFrame, drug: str, features: list[str], y: str = "y", cluster: str = "cluster", least_calibration_r: int = LEAST_CALIBRATION_R, distance_quantile: float = K.DISTANCE_QUANTILE) -> DrugModel:
    """``rows`` are one drug's. Calibrated by a logistic curve on the calibration split, or, where that
    has too few resistant rows, moved so that the best threshold of grouped out-of-fold scores of the
    training split becomes one half. Bands come from the calibration split."""
    train, cal = rows.filter("split = 'train'"), rows.filter("split = 'calibration'")
    out = DrugModel(drug, features, models.elastic_net(train, features, y), "platt")
    if cal.filter(F.col(y) == 1).count() >= least_calibration_r:
        out.slope, out.intercept = models.platt(models.probability(out.model, cal, "raw"), "raw", y)
    else:
        out.method = "shift"
        folded = splits.group_folds(train, cluster)
        out.tau = min(1 - 1e-9, max(1e-9, models.best_threshold(models.out_of_fold(folded, features, y), "p", y)))
    scored = models.probability(out.model, cal, "raw")
    scored = models.apply_platt(scored, "raw", out.slope, out.intercept, "p") if out.method == "platt" else scored.withColumn("p", logit_shift(F.col("raw"), F.lit(out.tau)))
    bands = nocall.conformal_bands(scored, [], y, "p").first()
    out.q_s, out.q_r = bands.q_s, bands.q_r
    if "distance" in rows.columns:
        out.distance_threshold = nocall.distance_threshold(cal.filter("distance is not null"), "distance", distance_quantile).first()[0]
    return out


def train_all(rows: DataFrame, features: list[str], drug: str = "drug", y: str = "y", cluster: str = "cluster", folder: str | None = None) -> tuple[dict[str, DrugModel], DataFrame, DataFrame]:
    """(models, scores of all rows of their drugs, summary with a ``status`` for each drug).

    A drug that can't be trained is skipped and says why. With ``folder`` bundles are saved there, and
    bundles of drugs that have no model now are deleted.
    """
    spark, counts = rows.sparkSession, {r[drug]: r.asDict() for r in split_counts(rows, drug, y).collect()}
    fitted, parts, summary = {}, [], []
    for name in sorted(counts):
        why = why_skipped(counts[name])
        if why is None:
            own = rows.filter(F.col(drug) == name)
            m = fitted[name] = train_drug(own, name, features, y, cluster)
            m.counts = {k: v for k, v in counts[name].items() if k != drug}
            parts.append(m.score(own))
            if folder:
                save_bundle(m, spark, folder)
        method = fitted[name].method if why is None else None
        summary.append((name, why or "trained", method, counts[name]["n"], counts[name]["n_r"]))
    if folder:
        delete_stale(spark, folder, list(fitted))
    scores = parts[0] if parts else rows.limit(0).withColumns({"raw": F.lit(0.0), "p": F.lit(0.0), "reason": F.lit(""), "no_call": F.lit(False)})
    for part in parts[1:]:
        scores = scores.unionByName(part)
    return fitted, scores, spark.createDataFrame(summary, "drug string, status string, calibration string, n long, n_r long")


def bundle_name(drug: str) -> str:
    """The folder of a drug's bundle: a different one for each name."""
    return quote(drug, safe="").replace(".", "%2E") or "%"


def save_bundle(model: DrugModel, spark: SparkSession, folder: str) -> None:
    """The pipeline and a JSON document with all else, over what is there."""
    path = f"{folder}/{bundle_name(model.drug)}"
    model.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(model.meta()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _meta(spark: SparkSession, path: str) -> dict | None:
    """The document of a bundle; None for anything else that may be at ``path``."""
    fs, p = _fs(spark, f"{path}/meta")
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return None
    try:
        lines = spark.read.text(f"{path}/meta").take(2)
        meta = json.loads(lines[0].value) if len(lines) == 1 else None
    except ValueError:
        return None
    return meta if isinstance(meta, dict) and {f.name for f in fields(DrugModel)} - {"model"} == set(meta) else None


def load_bundle(spark: SparkSession, path: str) -> DrugModel:
    meta = _meta(spark, path)
    if meta is None:
        raise ValueError(f"no bundle at {path}")
    return DrugModel(model=PipelineModel.load(f"{path}/model"), **meta)


def _bundles(spark: SparkSession, folder: str) -> dict[str, str]:
    """Path of each drug's bundle. What else lies in the folder is none of ours."""
    fs, path = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    found = {f"{folder}/{n}": _meta(spark, f"{folder}/{n}") for n in names}
    return {m["drug"]: p for p, m in found.items() if m is not None}


def load_all(spark: SparkSession, folder: str) -> dict[str, DrugModel]:
    """All bundles of a folder by drug; one with other features than wanted is the caller's to refuse."""
    return {drug: load_bundle(spark, path) for drug, path in _bundles(spark, folder).items()}


def delete_stale(spark: SparkSession, folder: str, drugs: list[str]) -> list[str]:
    """Delete the bundles of other drugs, and nothing that is no bundle; returns these drugs."""
    gone = {d: p for d, p in _bundles(spark, folder).items() if d not in drugs}
    for path in gone.values():
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return sorted(gone)
