"""Sources: tables of text fields, annotation hits, sequences, edge lists, configurations."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from phenospark.functions.normalize import composite_id


class MissingColumns(ValueError):
    """A file lacks columns that its kind must have."""


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def text_table(spark: SparkSession, path: str | list[str], sep: str = ",", comment: str | None = None) -> DataFrame:
    """All columns as text: an id like 562.144150 must not become a number. Empty fields are ''."""
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "")
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def backfill(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with missing columns added as '', and their names."""
    missing = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit("") for c in missing}) if missing else df, missing


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def stem(path: Column, ext: str) -> Column:
    """File name without its last extension; ids may contain dots."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), rf"^(.*)\.{ext}$", 1)


HIT_COLUMNS = ["Element symbol", "Element name", "Subtype", "Class", "Subclass", "Method"]


def annotation_hits(spark: SparkSession, path: str | list[str], required: list[str] | None = None) -> DataFrame:
    """Hits of all files, with ``genome_id`` from the file's name. Older files call the symbol 'Gene symbol'."""
    reader = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "")
    df = reader.csv(path).withColumn("genome_id", stem(F.col("_metadata.file_path"), "tsv"))
    if "Gene symbol" in df.columns:
        own = [F.col("`Element symbol`")] if "Element symbol" in df.columns else []
        df = df.withColumn("Element symbol", F.coalesce(*own, F.col("`Gene symbol`")))
    return require(df, HIT_COLUMNS if required is None else required)


def checked_hits(spark: SparkSession, path: str | list[str], required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, files): annotation hits of the files whose header has all required columns, and one row
    per file: ``path, genome_id, ok, missing, rows``.

    Files are told apart line by line, so one with another header spoils nothing but itself. The
    symbol may be called 'Gene symbol'; a hit without symbol, name, subtype and method (each '' or
    'na') names no feature and is left out of the hits. Columns beyond the known ones are not read.
    """
    wanted = HIT_COLUMNS if required is None else required
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"), F.col("value").alias("raw"))
    fields = F.transform(F.split("raw", "\t"), lambda x: F.trim(F.regexp_replace(x, "\r", "")))
    heads = lines.filter((F.col("start") == 0)).groupBy("path").agg(F.min_by(fields, "at").alias("head"), F.min("at").alias("first"))
    renamed = F.transform("head", lambda x: F.when((x == "Gene symbol") & ~F.array_contains("head", "Element symbol"), "Element symbol").otherwise(x))
    heads = heads.withColumn("head", renamed).withColumn("missing", F.array_except(F.array(*[F.lit(x) for x in wanted]), "head"))
    body = lines.join(heads, "path").filter((F.col("at") != F.col("first")) & (F.trim("raw") != ""))
    counted = body.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    files = heads.join(counted, "path", "left").select("path", stem(F.col("path"), "tsv").alias("genome_id"), (F.size("missing") == 0).alias("ok"), "missing", F.coalesce("rows", F.lit(0)).alias("rows"))
    good = body.filter(F.size("missing") == 0).withColumn("x", fields)
    at = lambda c: F.coalesce(F.try_element_at("x", F.nullif(F.array_position("head", c), F.lit(0)).cast("int")), F.lit(""))
    hits = good.select(stem(F.col("path"), "tsv").alias("genome_id"), *[at(c).alias(c) for c in dict.fromkeys([*HIT_COLUMNS, *wanted])])
    named = composite_id(*[F.col(f"`{c}`") for c in ("Element symbol", "Element name", "Subtype", "Method")])
    return hits.filter(named != "na|na|na|na"), files


def first_ids(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Distinct ids that aren't blank, sorted; the first ``n`` of them if asked for."""
    ids = df.select(F.trim(F.col(f"`{column}`").cast("string")).alias(column)).filter(F.col(column) != "").distinct().orderBy(column)
    return ids.limit(n) if n is not None else ids


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """``genome_id, split`` of a TSV; other columns are left out."""
    return require(text_table(spark, path, sep="\t"), ["genome_id", "split"]).select("genome_id", "split")


def drug_targets(spark: SparkSession, path: str) -> DataFrame:
    """``drug, target``: a row for each target of a JSON object from drug to a list of names."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("drug", "targets")).select("drug", F.explode("targets").alias("target"))


def feature_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(long table, axis) that writers.feature_store() wrote."""
    return spark.read.parquet(f"{path}/long"), spark.read.parquet(f"{path}/axis")


def fasta(spark: SparkSession, path: str | list[str], ext: str = "fna") -> DataFrame:
    """``genome_id, contig, seq``: one row per record, however long the file is; the record mark is the line separator."""
    raw = spark.read.option("lineSep", ">").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.expr("substring(value, length(regexp_extract(value, '^([^\\\\r\\\\n]*)', 1)) + 1)"), r"\s+", "")
    return raw.filter(F.trim("value") != "").select(stem(F.col("path"), ext).alias("genome_id"), F.element_at(F.split(F.trim(head), r"\s+"), 1).alias("contig"), F.upper(body).alias("seq"))


def ani_edges(spark: SparkSession, path: str) -> DataFrame:
    """``ref, query, ani, af_ref, af_query``; columns are found by part of their names, ids are stems."""
    df = text_table(spark, path, sep="\t")

    def find(*parts: str) -> Column:
        for c in df.columns:
            if all(p in c.lower() for p in parts):
                return F.col(f"`{c}`")
        raise MissingColumns(f"no column like {parts}")

    base = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.(fna|fa|fasta)(\.gz)?$", "")
    num = lambda c: c.try_cast("double")
    return df.select(base(find("ref", "file")).alias("ref"), base(find("query", "file")).alias("query"), num(find("ani")).alias("ani"), num(find("align", "ref")).alias("af_ref"), num(find("align", "query")).alias("af_query"))


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``key`` and the fields of a JSON object whose values have the schema ``value``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "x")).select("key", "x.*")


def yaml_config(path: str) -> Any:
    """A small rule or configuration file, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def breakpoint_table(spark: SparkSession, config: dict) -> DataFrame:
    """``species, drug, s_max, r_min`` from species -> drug -> limits; entries without both limits are left out."""
    rows = [(s, d, float(x["s_max_mg_l"]), float(x["r_min_mg_l"])) for s, ds in config.items() for d, x in (ds or {}).items() if x.get("s_max_mg_l") is not None and x.get("r_min_mg_l") is not None]
    return spark.createDataFrame(rows, "species string, drug string, s_max double, r_min double")


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of each line that isn't blank and doesn't start with '#'."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value != '' and not startswith(value, '#')")


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """Cohort labels with ``y``: 1 where the drug is likely to fail."""
    df = require(text_table(spark, path, sep="\t"), ["genome_id", "antibiotic", "label"])
    return df.withColumn("y", (F.col("label") == "likely_to_fail").cast("int"))


def links(pages: DataFrame, html: str, *keys: str, pattern: str | None = None) -> DataFrame:
    """Distinct link targets of pages, optionally those that match a pattern."""
    found = pages.select(*keys, F.explode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return (found.filter(F.col("href").rlike(pattern)) if pattern else found).distinct()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def fasta_summary(text: Column) -> Column:
    """Struct of a sequence text: records, bases, whether it may be used (a header, 20 bases, known letters, 10 MB)."""
    seq = F.regexp_replace(F.regexp_replace(text, r"(?m)^>[^\n]*$", ""), r"\s+", "")
    records = F.regexp_count(text, F.lit(r"(?m)^>"))
    ok = (records > 0) & (F.length(seq) >= 20) & ~seq.rlike("[^ACGTUNRYSWKMBDHVacgtunryswkmbdhv-]") & (F.length(text) <= 10_000_000)
    return F.struct(records.alias("records"), F.length(F.regexp_replace(seq, "[-Nn]", "")).alias("bases"), ok.alias("ok"))


def load_json(path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
