"""Sinks: sorted tables, matrices with metadata, nested JSON, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """Globally sorted by range; parts are in order."""
    df.orderBy(*keys).write.mode("overwrite").option("header", True).csv(path)


def feature_store(long: DataFrame, hits: DataFrame, path: str, entity: str, feature: str, kinds: list[str]) -> None:
    """The long matrix, its axis with numbers of entities, and counts of the hits' kinds: three tables."""
    from phenospark.operators.features import hit_counts

    long.write.mode("overwrite").parquet(f"{path}/long")
    long.groupBy(feature).agg(F.count(F.lit(1)).alias("n_entities")).write.mode("overwrite").parquet(f"{path}/axis")
    hit_counts(hits, kinds).write.mode("overwrite").json(f"{path}/metadata")


def as_json_map(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row ``value``: a JSON object from key to fields, keys sorted. For tables that fit one document."""
    entry = F.struct(F.col(key).cast("string").alias("key"), F.struct(*fields).alias("value"))
    return df.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def as_nested_json(df: DataFrame, outer: str, inner: str, fields: list[str]) -> DataFrame:
    """One row ``key, value`` for each outer key: a JSON object from inner key to fields, keys sorted."""
    entry = F.struct(F.col(inner).cast("string").alias("key"), F.struct(*fields).alias("value"))
    return df.groupBy(F.col(outer).alias("key")).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def json_document(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def probability_lines(df: DataFrame, version: str, entity: str) -> DataFrame:
    """``value``: lines of a CSV with a first line that names the version, p to six places, distance to two."""
    line = F.concat_ws(",", F.col(entity), F.format_string("%.6f", "p"), F.col("no_call").cast("int").cast("string"), F.col("reason"), F.format_string("%.2f", "distance"))
    head = df.sparkSession.createDataFrame([(0, f"# version={version}"), (1, f"{entity},p,no_call,reason,dist_to_train")], "ix int, value string")
    body = df.select(F.lit(2).alias("ix"), line.alias("value"))
    return head.unionByName(body).orderBy("ix", "value").select("value")


def metrics_json(df: DataFrame) -> DataFrame:
    """Rows as JSON; what isn't finite becomes null."""
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*clean).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def markdown_report(title: str, sections: list[tuple[str, DataFrame]], most: int = 200) -> str:
    """Sections of small aggregate tables; a longer one is cut at ``most`` lines, which the text says."""
    out = [f"# {title}", ""]
    for name, df in sections:
        rows = df.limit(most + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
        out += [f"(the first {most} rows)" if len(rows) > most else "", ""]
    return "\n".join(out)


def model_json(model) -> dict:
    """Weights of a fitted scaled logistic regression."""
    scaler, lr = model.stages[-2], model.stages[-1]
    return {"mean": list(scaler.mean), "std": list(scaler.std), "coefficients": list(lr.coefficients), "intercept": lr.intercept, "features": model.stages[0].getInputCols()}
