"""Search by words of a name and by parts of an id, from a table of postings instead of a scan.

A posting says that a document has a gram: the first letters of a word of its name, or one to three
letters of its id. It carries name and id, so a search reads the postings of the text's grams, which
are one directory each, and checks what it finds; the documents are not read. An upsert appends
postings under its number, and tombstones for grams that a document has no more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a word's beginning, and of a part of an id, in a gram.
HEAD, PART = 4, 3


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(name: Column, ident: Column) -> Column:
    heads = F.flatten(F.transform(_words(name), lambda w: F.transform(F.sequence(F.lit(1), F.least(F.length(w), F.lit(HEAD))), lambda n: F.concat(F.lit("w"), F.substr(w, F.lit(1), n)))))
    i = F.lower(ident)
    parts = [F.transform(F.when(F.length(i) >= n, F.sequence(F.lit(1), F.length(i) - n + 1)).otherwise(F.array().cast("array<int>")), lambda at: F.concat(F.lit("i"), F.substr(i, at, F.lit(n)))) for n in range(1, PART + 1)]
    return F.array_distinct(F.concat(heads, *parts))


@dataclass(frozen=True)
class NameIndex:
    """``ident`` is a column that tells documents apart; ``name`` may be null, which is no word."""

    path: str
    ident: str
    name: str
    buckets: int = 64

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def add(self, delta: DataFrame, version: int, before: DataFrame | None = None) -> None:
        """Index the documents of ``delta``, once each; ``before`` has those of them that were indexed, as they were.

        Versions rise. The same version again writes the same postings in place of what is there.
        """
        one = lambda df, c: df.select(F.col(self.ident), F.col(self.name), _grams(F.col(self.name), F.col(self.ident).cast("string")).alias(c))
        rows = one(delta, "grams").withColumn("gone", F.array().cast("array<string>"))
        if before is not None:
            old = one(before, "old").select(F.col(self.ident).alias("__i"), "old")
            rows = rows.drop("gone").join(old, F.col(self.ident) == F.col("__i"), "left")
            rows = rows.withColumn("gone", F.array_except(F.coalesce("old", F.array().cast("array<string>")), "grams"))
        both = F.explode(F.concat(F.transform("grams", lambda g: F.struct(g.alias("gram"), F.lit(True).alias("live"))), F.transform("gone", lambda g: F.struct(g.alias("gram"), F.lit(False).alias("live")))))
        out = rows.select(self.ident, self.name, both.alias("x")).select(self.ident, self.name, "x.gram", "x.live").withColumns({"bucket": self._bucket(F.col("gram")), "version": F.lit(version).cast("long")})
        # A bucket's postings lie in as many files as salts, sorted by gram, so row groups of others are skipped.
        dealt = out.repartition("bucket", F.pmod(F.xxhash64(self.ident), F.lit(8))).sortWithinPartitions("bucket", "gram")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")

    def _of(self, spark: SparkSession, grams: list[str]) -> DataFrame:
        """``ident, name, gram`` of documents that have the grams now."""
        asked = F.lit(False)
        for g in sorted(set(grams)):
            asked = asked | ((F.col("bucket") == self._bucket(F.lit(g))) & (F.col("gram") == g))
        rows = spark.read.option("basePath", self.path).parquet(self.path).filter(asked)
        last = F.max_by(F.struct("live", F.col(self.name).alias("name")), "version").alias("x")
        return rows.groupBy(self.ident, "gram").agg(last).filter("x.live").select(self.ident, F.col("x.name").alias(self.name), "gram")

    def search(self, spark: SparkSession, text: str, most: int = 20) -> DataFrame:
        """``ident, name`` of what store.search() finds: documents whose name has words that begin with all
        words of ``text``, ``most`` of them by id, and those whose id has ``text`` in it."""
        needle = text.strip().lower()
        if not needle:
            return self._of(spark, [""]).select(self.ident, self.name).limit(0)
        words = sorted(set(needle.split()))
        heads = sorted({f"w{w[:HEAD]}" for w in words})
        parts = sorted({f"i{needle[k : k + PART]}" for k in range(max(1, len(needle) - PART + 1))})
        found = self._of(spark, heads + parts)

        def having(grams: list[str]) -> DataFrame:
            some = found.filter(F.col("gram").isin(grams)).groupBy(self.ident).agg(F.count(F.lit(1)).alias("n"), F.max(self.name).alias(self.name))
            return some.filter(F.col("n") == len(grams)).select(self.ident, self.name)

        by_name = having(heads)
        for w in words:
            by_name = by_name.filter(F.exists(_words(F.col(self.name)), lambda x: x.startswith(F.lit(w))))
        by_id = having(parts).filter(F.lower(F.col(self.ident).cast("string")).contains(needle))
        return by_name.orderBy(self.ident).limit(most).unionByName(by_id).dropDuplicates([self.ident])
