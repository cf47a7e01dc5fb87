"""From raw documents to packed sequences: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phenospark.llm import decontamination, exact_dedup, ngram_join, packing, quality_classifier
from phenospark.llm._common import materialize, small_batches
from phenospark.storage import few_files


#: Of each stage's table, for each core of the cluster; more where the input is large (see storage.few_files).
FILES_PER_CORE = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows that op5 learns from.
    A null text is judged as an empty one; without two classes of labels nothing is rejected."""
    labels = quality_classifier.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    with small_batches(spark):
        stats = materialize(quality_classifier.document_statistics(docs), "statistics")
    return few_files(quality_classifier.keep_good(docs, quality_classifier.fit(stats, labels)), FILES_PER_CORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of rows equal in id and text one. Null counts as empty."""
    return few_files(exact_dedup.drop_copies(docs), FILES_PER_CORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id: 5-word shingles, Jaccard similarity
    of 0.8 or more. Texts without words stay."""
    return few_files(ngram_join.drop_near_copies(docs, join=ngram_join.Join(shingle=5, percent=80)), FILES_PER_CORE)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items none does."""
    return few_files(decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), FILES_PER_CORE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences. An empty or null text is one piece, its end."""
    return few_files(packing.pack(docs, capacity=packing.Capacity(tokens=2048, documents=2048, attention=2048**2)), FILES_PER_CORE)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packed),
]

#: Trained scores, tokenizers and components are beyond SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, FILES_PER_CORE)
    return STAGES[-1][1](spark, docs, sf_dir)
