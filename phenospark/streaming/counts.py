"""Running counts over a growing folder, as a stream and as a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from phenospark.storage import shared_dir


def class_counts(rows: DataFrame, classes: Column, ignore: tuple[str, ...] = ("", "NA", "MULTI")) -> DataFrame:
    """``cls, n``: rows per class, where a field may name several, separated by '/'."""
    each = F.explode(F.split(F.coalesce(classes, F.lit("")), "/"))
    return rows.select(each.alias("cls")).filter(~F.col("cls").isin(*ignore)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


def stream_folder(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files: int = 64) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process what is there now, with state checkpointed in the shared folder, and return the result table."""
    spark = stream.sparkSession
    import uuid

    at = f"{shared_dir(spark)}/phenospark/stream-{name}-{uuid.uuid4().hex}"
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(table)


def progress(done: DataFrame, time: str, total: int) -> DataFrame:
    """One row: how many are ``done`` of ``total``, ``per_hour`` and ``hours_left``; null rates for no time passed."""
    hours = (F.unix_timestamp(F.max(time)) - F.unix_timestamp(F.min(time))) / 3600.0
    g = done.agg(F.count(F.lit(1)).alias("done"), hours.alias("__h"))
    rate = F.try_divide("done", "__h")
    return g.select("done", F.lit(total).cast("long").alias("total"), F.round(rate, 3).alias("per_hour"), F.round(F.try_divide(F.lit(total) - F.col("done"), rate), 3).alias("hours_left"))


def windowed(rows: DataFrame, time: str, size: str, key: str, late: str = "1 hour") -> DataFrame:
    """``start, key, n`` per tumbling window; on a stream, state older than the watermark goes."""
    base = rows.withWatermark(time, late) if rows.isStreaming else rows
    return base.groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
