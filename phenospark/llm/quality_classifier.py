"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class is a Gaussian over transformed statistics of the text. Its covariance is shrunk towards
its own diagonal and a little towards the identity, so that it can be inverted however few rows
there are. The Cholesky factors are inverted once; a score is then a difference of two Mahalanobis
norms and log-determinants.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, materialize, slices, small_batches

FEATURES = ("length", "upper", "symbols", "exclamations", "bars", "stops", "digits", "other", "echo", "distinct", "word_length", "lines")
SHRINK, RIDGE = 0.1, 0.05
#: Counts are smoothed as if so many characters (or words) of ordinary text were added.
PSEUDO = 60.0
_UPPER = np.arange(65, 91)
_SYMBOLS = np.frombuffer(b"#$%&*^~<>{}[]\\@_=+/`", np.uint8)
_DIGITS = np.arange(48, 58)


def statistics(raw: bytes) -> list[float]:
    """Logarithms of smoothed shares of the whole text; defined for the empty text too."""
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    w = raw.split()
    k = len(w)
    share = lambda count, usual, total=n: float(np.log((count + usual * PSEUDO) / (total + PSEUDO)))
    two_byte_upper = raw.count(b"\xc3") and sum(raw.count(bytes((0xC3, x))) for x in range(0x80, 0x9F))
    return [
        float(np.log(n + PSEUDO)),
        share(c[_UPPER].sum() + two_byte_upper, 0.02),
        share(c[_SYMBOLS].sum(), 0.002),
        share(c[33], 0.001),
        share(c[124], 0.001),
        share(c[44] + c[46], 0.02),
        share(c[_DIGITS].sum(), 0.002),
        share(c[128:].sum(), 0.05),
        share(sum(map(eq, w, w[1:])), 0.01, k),
        share(len(set(w)), 0.7, k),
        share(n - k, 5.0, k),
        share(c[10], 0.003),
    ]


@dataclass
class QuadraticDiscriminant:
    mean: np.ndarray  # (2, d)
    inverse: np.ndarray  # (2, d, d): of the Cholesky factors
    offset: np.ndarray  # (2,): log prior minus half the log-determinant

    @classmethod
    def from_moments(cls, n: np.ndarray, s: np.ndarray, ss: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> QuadraticDiscriminant:
        """From the number, sum and sum of outer products of the rows of class 0 and class 1."""
        d = s.shape[1]
        total = max(n.sum(), 1.0)
        pooled_mean = s.sum(0) / total
        pooled = ss.sum(0) / total - np.outer(pooled_mean, pooled_mean)
        mean, inverse, offset = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
        for k in (0, 1):
            mean[k] = s[k] / n[k] if n[k] else pooled_mean
            cov = ss[k] / n[k] - np.outer(mean[k], mean[k]) if n[k] > 1 else pooled
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(d)
            low = np.linalg.cholesky(cov)
            inverse[k] = np.linalg.inv(low)
            offset[k] = np.log((n[k] + 1) / (total + 2)) - np.log(np.diag(low)).sum()
        return cls(mean, inverse, offset)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, above one half where class 1 is likelier. The log-odds are divided by the number
        of statistics: their order and sign stay, and scores don't all round to 0 or 1."""
        if not len(x):
            return np.zeros(0)
        log_density = [self.offset[k] - 0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((log_density[1] - log_density[0]) / x.shape[1], -500, 500)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and one double column for each of FEATURES, from the whole text of each row.

    A null text is empty. Repeated rows give repeated results; other columns, under whatever name,
    are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t or b"") for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["id", *FEATURES])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, " + ", ".join(f"{x} double" for x in FEATURES))


def fit(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", label: str = "quality") -> QuadraticDiscriminant:
    """Fit on all rows of ``stats`` that have a label; one row of sums a class reaches the driver.

    An id with labels that contradict each other, or a null one, counts as unlabelled.
    """
    one = labels.groupBy(F.col(label_id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("__y"))
    one = one.filter((F.col("y") == F.col("__y")) & F.col("y").isin(0, 1)).select("id", F.col("y").cast("int").alias("y"))
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in stats.join(one, "id").groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        n[r.y] = r.n
        s[r.y] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            ss[r.y, i, j] = ss[r.y, j, i] = r[f"p{i}_{j}"]
    return QuadraticDiscriminant.from_moments(n, s, ss)


def score_statistics(stats: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """``id, score`` for each row of document_statistics(); without training rows all score one half or near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(x))], names=["id", "score"])

    return stats.mapInArrow(run, f"id {dict(stats.dtypes)['id']}, score double")


def keep_good(docs: DataFrame, model: QuadraticDiscriminant, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns, in one pass.

    A null text is scored as the empty one. Rows that are the same stay or go together.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics((t or "").encode("utf-8", "surrogatepass")) for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def training_rows(table: DataFrame, id_col: str) -> DataFrame:
    return table.filter(crc_mod(id_col, 3) != 1)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Nulls: a null text is empty. Repeated documents are scored, and learned from, each."""
    with small_batches(spark):
        stats = materialize(document_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "statistics")
    model = fit(stats, training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id"))
    return score_statistics(stats, model).select(
        F.col("id").alias("doc_id"), (crc_mod("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
