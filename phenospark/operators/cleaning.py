"""The clean-label job: raw laboratory rows to one label per entity and drug, with its audit.

The job is one chain of column expressions and two aggregates; the audit is a few aggregates of the
same rows. Nothing reaches the driver but what a report is made of.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions import constants as K
from phenospark.functions import normalize as N
from phenospark.sources.readers import backfill

from . import labels

#: The columns of a raw table of laboratory results.
RAW_COLUMNS = [
    "Genome ID", "Antibiotic", "Resistant Phenotype", "Measurement", "Measurement Sign", "Measurement Value", "Measurement Unit",
    "Laboratory Typing Method", "Laboratory Typing Platform", "Testing Standard", "Testing Standard Year", "Evidence",
]
#: The evidence that counts, and units in which a measurement can be read.
LAB_EVIDENCE, UNITS = "Laboratory Method", ("mg/L", "")


@dataclass
class CleanLabels:
    """``rows``: all raw rows with what was derived of them; ``labels``: the result; ``missing``: columns
    that the input lacked and that counted as empty."""

    rows: DataFrame
    labels: DataFrame
    missing: list[str]


def normalized_rows(raw: DataFrame, names: DataFrame, limits: DataFrame) -> DataFrame:
    """A row for each raw row: ``kept`` says whether it is laboratory evidence on a known drug.

    ``names`` (raw, canonical) and ``limits`` (drug, s_max, r_min) are small tables. Null fields
    count as empty. ``position`` numbers rows in the order they are read.
    """
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    method, unit = text("Laboratory Typing Method"), text("Measurement Unit")
    rows = raw.select(
        F.monotonically_increasing_id().alias("position"),
        N.identifier(F.col("`Genome ID`")).alias("genome_id"),
        N.drug_bucket(F.col("Antibiotic")).alias("bucket"),
        text("Resistant Phenotype").alias("phenotype"),
        method.alias("method"),
        N.mic_like(method, text("Laboratory Typing Platform")).alias("mic_like"),
        N.mic(text("Measurement Value"), text("Measurement Sign"), text("Measurement")).alias("mic"),
        unit.isin(*UNITS).alias("unit_ok"),
        N.standard(text("Testing Standard")).alias("testing_standard"),
        N.year(text("Testing Standard Year")).alias("testing_standard_year"),
        (text("Evidence") == LAB_EVIDENCE).alias("lab"),
    )
    rows = labels.resolve_names(rows, F.col("bucket"), names).withColumnRenamed("canonical", "drug")
    rows = rows.join(limits.select("drug", "s_max", "r_min"), "drug", "left")
    measured = F.col("mic_like") & F.col("mic").isNotNull() & F.col("unit_ok")
    call = N.censored_call(F.col("mic.value"), F.col("mic.sign"), F.col("s_max"), F.col("r_min"))
    return rows.select(
        "*", (F.col("lab") & F.col("drug").isNotNull()).alias("kept"), F.coalesce(measured, F.lit(False)).alias("measured"), F.when(measured, call).alias("rederived"),
        N.submitted_call(F.col("phenotype")).alias("submitted"),
    )


def clean_labels(raw: DataFrame, names: DataFrame, limits: DataFrame) -> CleanLabels:
    """The whole job. An empty table gives no labels; repeated rows vote each."""
    full, missing = backfill(raw, RAW_COLUMNS)
    rows = normalized_rows(full, names, limits)
    found = labels.resolve_conflicts(rows.filter("kept").withColumnRenamed("drug", "antibiotic"), ["genome_id", "antibiotic"], "submitted", "rederived", "testing_standard_year", "position", "testing_standard")
    return CleanLabels(rows, found, missing)


def _method_class() -> Column:
    return F.when(F.col("mic_like"), "MIC-like").when(F.lower("method").contains("disk"), "Disk diffusion").otherwise("Other/unknown")


def audit(job: CleanLabels) -> list[tuple[str, DataFrame]]:
    """The ten sections of the report, as tables sorted by falling counts."""
    lab, kept = job.rows.filter("lab"), job.rows.filter("kept")
    n = F.count(F.lit(1)).alias("rows")
    count = lambda df, *by: df.groupBy(*by).agg(n).orderBy(F.desc("rows"), *by)
    flag = lambda c, name: F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(name)
    raw = job.rows.agg(n, flag(~F.col("lab"), "other_evidence"), F.countDistinct(F.when(F.col("lab"), F.col("genome_id"))).alias("genomes"))
    raw = raw.withColumn("missing_columns", F.lit(", ".join(job.missing)))
    names = count(lab.withColumn("canonical", F.coalesce("drug", F.lit("(untrusted)"))).filter("drug is null or bucket != drug"), "bucket", "canonical")
    shown = lambda c, empty: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(empty))
    mics = kept.filter("measured").groupBy("drug").agg(n, flag(F.col("s_max").isNull() | F.col("r_min").isNull(), "skipped_without_limits")).orderBy(F.desc("rows"), "drug")
    flips = labels.flip_rate(kept, "drug", "submitted", "rederived").orderBy(F.col("drug").asc_nulls_first())
    inter = kept.filter(F.lower("phenotype") == "intermediate").withColumn("class", N.i_category(F.col("testing_standard"), F.col("testing_standard_year")))
    other = kept.filter(F.col("submitted").isNull() & (F.lower("phenotype") != "intermediate")).withColumn("class", F.concat(F.lit("other: "), shown("phenotype", "(empty)")))
    decided = labels.conflict_stats(kept, ["genome_id", "drug"], "submitted", "rederived", "testing_standard_year").orderBy("outcome")
    final = labels.class_counts(job.labels, "genome_id", "antibiotic").orderBy("antibiotic")
    return [
        ("1. Raw table", raw),
        ("2. Phenotypes", count(kept.withColumn("value", shown("phenotype", "(empty)")), "value")),
        ("3. Methods", count(kept.withColumn("class", _method_class()), "class")),
        ("4. Testing standard and year", count(kept.select(shown("testing_standard", "(none)").alias("standard"), shown("testing_standard_year", "(none)").alias("year")), "standard", "year")),
        ("5. Drug names mapped or left out", names),
        ("6. Rows of each name", count(lab, "bucket")),
        ("7. Measurements read again, and how calls differ", mics.join(flips.select("drug", "flips", F.col("n").alias("comparable"), "rate"), "drug", "left")),
        ("8. Intermediate and other phenotypes", count(inter.select("class").unionByName(other.select("class")), "class")),
        ("9. Conflicts", decided),
        ("10. Labels", final),
    ]


#: Limits as a table for normalized_rows(); a drug without both limits isn't in it.
def limit_table(spark, limits: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(d, float(s), float(r)) for d, (s, r) in sorted(limits.items())], "drug string, s_max double, r_min double")


def default_names(spark) -> DataFrame:
    return labels.name_table(spark, K.SYNONYMS, K.canonical_names())
