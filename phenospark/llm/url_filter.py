"""URL rules by a sort-merge range join.

A rule is a host and a path; it fits the host and all its subdomains where the url's path starts
with its own. With the labels of hosts reversed ("blog.example.net" -> "net.example.blog."), the
hosts that a rule fits are one interval of the sorted keys, and intervals nest or are disjoint.
Urls are dealt to ranges of (key, salt): the salt lets one very frequent host span many ranges.
A rule goes to every range that its interval meets. In each range, urls and rules are sorted and
swept once, with the rules whose interval is open on a stack.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TOP = "\U0010ffff"
#: Ranges for each shuffle partition, and sampled keys for each range; both bound what the driver gathers.
RANGES_PER_PARTITION = 4
KEYS_PER_RANGE = 10


def _key(host):
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def parse_urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    return parsed.select("*", _key(F.col("host")).alias("key"), F.xxhash64("id", F.monotonically_increasing_id()).alias("salt"))


def _boundaries(urls: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """About ``ranges`` - 1 keys that deal the urls evenly; from a sample of bounded size."""
    rows, want = urls.count(), ranges * KEYS_PER_RANGE
    picked = urls.select("key", "salt")
    if rows > want:
        picked = picked.sample(fraction=min(1.0, want / rows), seed=1)
    keys = sorted((r.key, r.salt) for r in picked.collect())
    step = max(1, len(keys) // ranges)
    return sorted(set(keys[step::step]))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``verdict, host, path``. Of the rules that fit, the one with the longest text
    ``host + path`` wins, of equally long ones the one with the longer host; a rule that is given
    twice counts with the verdict that sorts first. Where none fits, ``rule`` is null and the verdict
    is ``default``. A null url, or one without ``://``, has an empty host and path. Repeated rows
    give repeated results; other columns are not read. Without pages the result is empty, without
    rules all urls get ``default``.
    """
    spark = pages.sparkSession
    urls = parse_urls(pages, id_col, url_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = _boundaries(urls, parts * RANGES_PER_PARTITION)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, salts = b.column("key").to_pylist(), b.column("salt").to_pylist()
            yield b.append_column("range", pa.array([bisect_right(edges, x) for x in zip(keys, salts)], pa.int32()))

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = -(1 << 63)
        for b in batches:
            lo = [bisect_right(edges, (k, low)) for k in b.column("key").to_pylist()]
            hi = [bisect_right(edges, (k + _TOP, -low)) for k in b.column("key").to_pylist()]
            yield b.append_column("lo", pa.array(lo, pa.int32())).append_column("hi", pa.array(hi, pa.int32()))

    id_type = dict(urls.dtypes)["id"]
    left = urls.mapInArrow(deal, f"id {id_type}, host string, path string, key string, salt long, range int")
    left = left.select("range", "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    keyed = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select("*", _key(F.col("host")).alias("key"))
    right = keyed.mapInArrow(span, "host string, path string, verdict string, key string, lo int, hi int")
    right = right.select(F.explode(F.sequence("lo", "hi")).alias("range"), "key", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "host", "path", "verdict")
    both = left.unionByName(right).repartition(parts, "range").sortWithinPartitions("range", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []  # of (key, host, path -> verdict, lengths of the paths)
        for b in batches:
            keep, rule, verdict = [], [], []
            columns = (b.column(n).to_pylist() for n in ("range", "key", "kind", "host", "path", "verdict"))
            for i, (rng, key, kind, host, path, said) in enumerate(zip(*columns)):
                if rng != at:
                    at, stack = rng, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, set()))
                    stack[-1][2][path] = said
                    stack[-1][3].add(len(path))
                    continue
                best, won = (-1, -1), None
                for _, h, paths, lengths in stack:
                    for n in lengths:
                        if n <= len(path) and path[:n] in paths and (len(h) + n, len(h)) > best:
                            best, won = (len(h) + n, len(h)), (h + path[:n], paths[path[:n]])
                keep.append(i)
                rule.append(won and won[0])
                verdict.append(won[1] if won else default)
            rows = b.take(pa.array(keep, pa.int64()))
            cols = [rows.column("id"), rows.column("host"), rows.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "host", "path", "rule", "verdict"])

    judged = both.mapInArrow(sweep, f"id {id_type}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("id", id_col)


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(pages, rules)


OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
r AS (
  SELECT page_id, host, path,
         CASE WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
