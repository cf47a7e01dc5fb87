"""From raw measurements to one label per entity and drug."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_names(rows: DataFrame, raw: Column, names: DataFrame) -> DataFrame:
    """Add ``canonical``; ``names`` (raw, canonical) is a small dimension, broadcast by its size."""
    dim = names.select(F.col("raw").alias("__raw"), "canonical").dropDuplicates(["__raw"])
    return rows.withColumn("__raw", raw).join(dim, "__raw", "left").drop("__raw")


def rejected_names(rows: DataFrame, raw: Column, names: DataFrame) -> DataFrame:
    """Counts of names that ``names`` doesn't know."""
    return rows.select(raw.alias("raw")).join(names.select("raw"), "raw", "left_anti").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


def name_table(spark, synonyms: list[tuple[str, str]], canonical: list[str]) -> DataFrame:
    known = {c: c for c in canonical} | dict(synonyms)
    return spark.createDataFrame(sorted(known.items()), "raw string, canonical string")


def flip_rate(rows: DataFrame, by: str, submitted: str, rederived: str) -> DataFrame:
    """How often the call that was submitted differs from the one derived anew; a row per group and
    one (group null) for all, in one pass."""
    both = rows.filter(F.col(submitted).isNotNull() & F.col(rederived).isNotNull())
    flips = F.sum((F.col(submitted) != F.col(rederived)).cast("int"))
    return both.rollup(by).agg(flips.alias("flips"), F.count(F.lit(1)).alias("n")).withColumn("rate", F.try_divide("flips", "n"))


def audit_counts(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Long table ``key, value, n`` of several frequency counters in one scan and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in keys.items()])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.key", "x.value").agg(F.count(F.lit(1)).alias("n"))


def _ballots(rows: DataFrame, keys: list[str], submitted: str, rederived: str, year: str, first: Column) -> DataFrame:
    """A row for each kind of vote of a group: ``__s, __r, __y``, how many rows cast it (``__k``) and the
    smallest ``first`` of them (``__first``); with what counts in the group: ``__has, __all, __call, __last``.

    Kinds are counted where the rows are, so a group with very many rows is a few rows from then on,
    and the windows see no others.
    """
    kinds = rows.select(*keys, F.col(submitted).alias("__s"), F.col(rederived).alias("__r"), F.col(year).alias("__y"), first.alias("__f"))
    kinds = kinds.groupBy(*keys, "__s", "__r", "__y").agg(F.count(F.lit(1)).alias("__k"), F.min("__f").alias("__first"))
    w = Window.partitionBy(*keys)
    pool = kinds.withColumn("__has", F.max(F.col("__r").isNotNull()).over(w)).withColumn("__all", F.sum("__k").over(w))
    pool = pool.withColumn("__call", F.when(F.col("__has"), F.col("__r")).otherwise(F.col("__s")))
    return pool.withColumn("__last", F.max(F.when(F.col("__call").isNotNull(), F.col("__y"))).over(w))


def resolve_conflicts(rows: DataFrame, keys: list[str], submitted: str, rederived: str, year: str, position: str, standard: str | None = None) -> DataFrame:
    """One row per group of ``keys``, or none where its votes are tied or empty.

    If a call has been derived anew for any row of the group, only such calls count, else the
    submitted ones. If any of them has a year, those of the last year count. The majority wins. The
    standard and year are those of the winner's first row by ``position``. ``n_source_rows`` counts
    all rows of the group.
    """
    std = F.col(standard) if standard else F.lit(None).cast("string")
    of_row = F.struct(F.col(position).alias("__p"), std.alias("__std"), F.col(year).alias("__y"))
    pool = _ballots(rows, keys, submitted, rederived, year, of_row).filter("__call is not null and (__last is null or __y = __last)")
    first = lambda k: F.min(F.when(F.col("__call") == k, F.col("__first")))
    votes = pool.groupBy(*keys).agg(
        F.sum(F.col("__call") * F.col("__k")).alias("__n1"), F.sum("__k").alias("__n"), F.first("__has").alias("__has"), F.first("__all").alias("n_source_rows"), first(1).alias("__one"), first(0).alias("__zero")
    )
    votes = votes.filter("2 * __n1 != __n").withColumn("label", (F.col("__n1") * 2 > F.col("__n")).cast("int"))
    won = F.when(F.col("label") == 1, F.col("__one")).otherwise(F.col("__zero"))
    out = votes.select(*keys, "label", F.when(F.col("__has"), "rederived").otherwise("submitted").alias("label_source"), won.getField("__std").alias("testing_standard"), won.getField("__y").alias("testing_standard_year"), "n_source_rows")
    return out if standard else out.drop("testing_standard")


def conflict_stats(rows: DataFrame, keys: list[str], submitted: str, rederived: str, year: str) -> DataFrame:
    """How groups were decided: counts by ``outcome`` (empty, tie, unanimous, majority)."""
    pool = _ballots(rows, keys, submitted, rederived, year, F.lit(0))
    counted = F.when(F.col("__call").isNotNull() & (F.col("__last").isNull() | (F.col("__y") == F.col("__last"))), F.col("__k")).otherwise(0)
    g = pool.groupBy(*keys).agg(F.sum(F.col("__call") * counted).alias("n1"), F.sum(counted).alias("n"))
    outcome = F.when(F.col("n") == 0, "empty").when(F.col("n1") * 2 == F.col("n"), "tie").when(F.col("n1").isin(0) | (F.col("n1") == F.col("n")), "unanimous").otherwise("majority")
    return g.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(labels: DataFrame, entity: str, by: str, label: str = "label") -> DataFrame:
    return labels.groupBy(by).agg(F.sum((F.col(label) == 1).cast("int")).alias("n_resistant"), F.sum((F.col(label) == 0).cast("int")).alias("n_susceptible"), F.countDistinct(entity).alias("n_entities"))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by ``order``, columns in rising order, which must say which that is.
    One aggregate that tasks combine first, so a group of any size is no burden."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*[c if c in keys else F.col(f"__x.{c}").alias(c) for c in rows.columns])


def score_groups(rows: DataFrame, group: str, sub: str, entity: str, label: str, least_each: int, least_entities: int) -> DataFrame:
    """Groups ranked by how many subgroups have enough of both classes and enough entities."""
    per = rows.groupBy(group, sub).agg(F.sum((F.col(label) == 1).cast("int")).alias("r"), F.sum((F.col(label) == 0).cast("int")).alias("s"), F.countDistinct(entity).alias("e"))
    good = ((F.col("r") >= least_each) & (F.col("s") >= least_each) & (F.col("e") >= least_entities)).cast("int")
    total = rows.groupBy(group).agg(F.countDistinct(entity).alias("n_entities"))
    return per.groupBy(group).agg(F.sum(good).alias("n_good")).join(total, group)


def rank_groups(rows: DataFrame, group: str, sub: str, entity: str, label: str, priority: list[str], least_each: int = 50, least_entities: int = 200, size: tuple[int, int] = (0, 1 << 62)) -> DataFrame:
    """``group, n_good, priority_rank, size_penalty, n_entities, good``, best first.

    ``good`` are the subgroups with enough rows of both classes and enough entities, those with most
    entities first. Groups are ordered by the number of good subgroups, by their place in
    ``priority`` (999 if in none), by how far their number of entities is off ``size``, by entities, by name.
    """
    per = rows.groupBy(group, sub).agg(F.sum((F.col(label) == 1).cast("int")).alias("r"), F.sum((F.col(label) == 0).cast("int")).alias("s"), F.countDistinct(entity).alias("e"))
    good = (F.col("r") >= least_each) & (F.col("s") >= least_each) & (F.col("e") >= least_entities)
    listed = F.sort_array(F.collect_list(F.when(good, F.struct((-F.col("e")).alias("k"), F.col(sub).alias("name")))))
    own = per.groupBy(group).agg(F.transform(listed, lambda x: x["name"]).alias("good"))
    n = rows.groupBy(group).agg(F.countDistinct(entity).alias("n_entities"))
    at = F.array_position(F.array(*[F.lit(x) for x in priority]).cast("array<string>"), F.col(group)) - 1
    off = F.greatest(F.lit(size[0]) - F.col("n_entities"), F.col("n_entities") - F.lit(size[1]), F.lit(0))
    out = own.join(n, group).select(group, F.size("good").alias("n_good"), F.when(at >= 0, at).otherwise(999).cast("int").alias("priority_rank"), off.cast("long").alias("size_penalty"), "n_entities", "good")
    return out.orderBy(F.desc("n_good"), "priority_rank", "size_penalty", F.desc("n_entities"), group)
