"""Bloom filters as tables of bitmaps: (bucket, bitmap) rows of 4 kB, built and probed by Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

BITMAP_BITS = 32_768  # of bitmap_construct_agg
#: A filter is broadcast. This many bits (128 MB) is the most it takes, whatever the input is.
MAX_FILTER_BITS = 1 << 30
BITS_PER_KEY = 16
HASHES = 2


def filter_bits(keys: int, most: int = MAX_FILTER_BITS) -> int:
    bits = BITMAP_BITS
    while bits < min(BITS_PER_KEY * keys, most):
        bits *= 2
    return bits


def slots(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def pack(taken: DataFrame) -> DataFrame:
    """Of a column ``__slot``; materialized, since every use would compute it again."""
    packed = taken.groupBy(F.floor(F.col("__slot") / BITMAP_BITS).alias("__bucket")).agg(F.bitmap_construct_agg(F.col("__slot") % BITMAP_BITS).alias("__bitmap"))
    return materialize(packed, "filter")


def member_filter(keys: DataFrame, column: str, bits: int) -> DataFrame:
    return pack(keys.select(F.explode(F.array(*slots(F.col(column), bits))).alias("__slot")))


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("long"), (position % 8).cast("int")) == 1, F.lit(False))


def probe(df: DataFrame, key: Column, found: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``__hit``: false where ``key`` is certainly not in the filter. No row moves."""
    cols = df.columns
    for i, slot in enumerate(slots(key, bits)):
        part = F.broadcast(found.select(F.col("__bucket").alias(f"__b{i}"), F.col("__bitmap").alias(f"__m{i}")))  # bits / 8 bytes at most
        df = df.withColumn(f"__s{i}", slot)
        df = df.join(part, F.floor(F.col(f"__s{i}") / BITMAP_BITS) == F.col(f"__b{i}"), "left")
        df = df.withColumn(f"__hit{i}", _bit(F.col(f"__m{i}"), F.col(f"__s{i}") % BITMAP_BITS)).drop(f"__b{i}", f"__m{i}", f"__s{i}")
    hit = F.col("__hit0")
    for i in range(1, HASHES):
        hit = hit & F.col(f"__hit{i}")
    return df.select(*cols, hit.alias("__hit"))
