"""Exact deduplication by a two-pass Bloom filter. DataFrame functions only.

Pass 1 sends every text hash through two filters. Slots that have been set before are set in the
second filter, so that one ends up holding the slots that two rows or more have asked for. A task
packs the slots that it sets to arrays of two bytes a slot, one for each of the filter's bitmaps of
32,768 bits, so its shuffle has as many rows as the filter has bitmaps, not as the input has rows.
Arrays of 64 tasks at a time become slots set once and slots set again; these meet by bitmap.

Pass 2 probes the second filter: a hash with a slot missing there is certainly unique, so its row
passes straight through, in the same stage as the scan. Only rows that hit are written, grouped and
joined. A false positive costs a row's trip through the shuffle, never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from ._common import materialize

#: A hash with more than this share of the repeated rows is heavy; so at most its inverse are.
HEAVY_SHARE = 1 / 1000
HEAVY_ROWS = 64


#: Tasks whose slots are merged first. So what meets in a task has a bound, even for a slot that every row sets.
TASKS_MERGED = 64


def repeated_filter(digests: DataFrame, column: str, bits: int) -> DataFrame:
    """The second filter: the slots that two rows or more have set."""
    slot = F.explode(F.array(*bitmaps.slots(F.col(column), bits)))
    merged = F.floor(F.spark_partition_id() / TASKS_MERGED).cast("int")
    taken = digests.select(slot.alias("__slot"), merged.alias("__merged"))
    bucket, low = F.floor(F.col("__slot") / bitmaps.BITMAP_BITS).alias("__bucket"), (F.col("__slot") % bitmaps.BITMAP_BITS).cast("short")
    lows = taken.groupBy(bucket, "__merged").agg(F.collect_list(low).alias("__lows"))
    # The following steps keep the partitioning by bucket and merged tasks: no row moves.
    counted = lows.select("__bucket", "__merged", F.explode("__lows").alias("__low")).groupBy("__bucket", "__merged", "__low").agg(F.count(F.lit(1)).alias("__n"))
    times = F.when(F.col("__n") > 1, F.array("__low", "__low")).otherwise(F.array("__low"))
    own = counted.groupBy("__bucket", "__merged").agg(F.flatten(F.collect_list(times)).alias("__lows"))
    by_bucket = own.select("__bucket", "__lows").repartition("__bucket")
    again = by_bucket.select("__bucket", F.explode("__lows").alias("__low")).groupBy("__bucket", "__low").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return materialize(again.groupBy("__bucket").agg(F.bitmap_construct_agg("__low").alias("__bitmap")), "filter")


def annotate_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    payload: list[str] | None = None,
    max_filter_bits: int = bitmaps.MAX_FILTER_BITS,
) -> DataFrame:
    """Every row of ``docs`` with ``__digest, __keep_id, __group_size, __kept`` added.

    Texts are equal when they are identical; a null text counts as empty. Of a group the row with
    the largest id stays; a null id is the smallest. Of repeated rows that tie, one stays. With
    ``payload`` only those columns are carried on, and texts are read and hashed once: both passes
    read what is written of them. Other columns, under any name that has no leading ``__``, pass
    through unchanged. Very long texts are hashed like others. An empty table gives an empty result.
    """
    cols = payload if payload is not None else docs.columns
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    hashed = docs.select(*cols, digest.alias("__digest"))
    if payload is not None:
        hashed = materialize(hashed, "digests")
    bits = bitmaps.filter_bits(hashed.count(), max_filter_bits)
    found = repeated_filter(hashed.select("__digest"), "__digest", bits)
    probed = bitmaps.probe(hashed, F.col("__digest"), found, bits)
    hit = F.col("__hit")

    alone = probed.filter(~hit).select(
        *cols, "__digest", F.col(id_col).alias("__keep_id"), F.lit(1).cast("long").alias("__group_size"), F.lit(True).alias("__kept")
    )
    # The number is written with the row, so it stays the same however often the row is read.
    maybe = materialize(probed.filter(hit).select(*cols, "__digest", F.monotonically_increasing_id().alias("__row")), "copies")
    groups = maybe.groupBy("__digest").agg(
        F.max(F.struct(F.col(id_col).alias("id"), (-F.col("__row")).alias("row"))).alias("__top"), F.count(F.lit(1)).alias("__group_size")
    )
    groups = materialize(groups, "copy-groups")
    least = max(HEAVY_ROWS, int(maybe.count() * HEAVY_SHARE))
    heavy = F.broadcast(groups.filter(F.col("__group_size") > least))  # fewer than 1 / HEAVY_SHARE rows
    light = groups.filter(F.col("__group_size") <= least)
    first = maybe.join(heavy, "__digest", "left")
    rest = first.filter(F.col("__group_size").isNull()).drop("__top", "__group_size").join(light, "__digest")
    grouped = first.filter(F.col("__group_size").isNotNull()).unionByName(rest).select(
        *cols, "__digest", F.col("__top.id").alias("__keep_id"), "__group_size", (F.col("__row") == -F.col("__top.row")).alias("__kept")
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    return annotate_copies(docs, id_col, text_col).filter("__kept").select(*docs.columns)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return annotate_copies(docs, payload=["doc_id"]).select(
        "doc_id",
        F.col("__keep_id").alias("keep_id"),
        F.col("__group_size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )


OP4_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
