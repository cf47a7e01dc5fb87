"""Document-store operators: upsert, last status, nested trees, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, fields of ``delta`` that aren't null win."""
    d = delta.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in delta.columns if c != key])
    j = base.join(d, base[key] == d["__k"], "full")
    fields = [F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in d.columns else F.col(c) for c in base.columns if c != key]
    return j.select(F.coalesce(base[key], d["__k"]).alias(key), *fields)


def latest(events: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """The fields of each key's last event. One aggregate with map-side combination, no window."""
    rank = F.struct(*order)
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), rank).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in fields])


def tree(parents: DataFrame, children: DataFrame, parent_key: str, child_parent: str, child_key: str, newest: str) -> DataFrame:
    """Parents with ``children``: an array of (newest, child_key) from the newest on; empty if there are none."""
    kids = children.groupBy(child_parent).agg(F.sort_array(F.collect_list(F.struct(F.col(newest), F.col(child_key))), asc=False).alias("children"))
    j = parents.join(kids, parents[parent_key] == kids[child_parent], "left").drop(child_parent)
    return j.withColumn("children", F.coalesce("children", F.array().cast(dict(kids.dtypes)["children"])))


def search(rows: DataFrame, text: str, name: str, ident: str, most: int = 20) -> DataFrame:
    """Rows whose name has all words of ``text`` (``most`` at most, by id) or whose id contains it.

    A blank text finds nothing. Case doesn't count.
    """
    needle = text.strip().lower()
    if not needle:
        return rows.filter(F.lit(False))
    words = F.split(F.lower(F.col(name)), r"[^\p{L}\p{N}]+")
    by_name = rows
    for w in needle.split():
        word = F.lit(w)
        by_name = by_name.filter(F.size(F.filter(words, lambda x: F.startswith(x, word))) > 0)  # noqa: B023
    by_id = rows.filter(F.lower(F.col(ident).cast("string")).contains(needle))
    return by_name.orderBy(ident).limit(most).unionByName(by_id).dropDuplicates([ident])


def layout(tree_rows: DataFrame, group: str, order: list[Column], size: Column, unit: int = 64) -> DataFrame:
    """``top``: where each row starts if rows are stacked in order, each ``max(size, 1) * unit`` high."""
    w = Window.partitionBy(group).orderBy(*order)
    height = F.greatest(size, F.lit(1)) * unit
    return tree_rows.withColumn("height", height).withColumn("top", F.coalesce(F.sum(height).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def with_parent(children: DataFrame, parents: DataFrame, child_parent: str, parent_key: str, fields: list[str]) -> DataFrame:
    """Children with fields of their parent, null where it is unknown. Keys of parents are unique."""
    found = parents.select(F.col(parent_key).alias(child_parent), *fields)
    return children.join(found, child_parent, "left")


def attach(documents: DataFrame, reports: DataFrame, key: str, newest: str, field: str = "report") -> DataFrame:
    """Documents with the newest report that names them under ``field``, and ``n_reports``."""
    rest = [c for c in reports.columns if c != key]
    last = reports.groupBy(key).agg(F.max_by(F.struct(*rest), newest).alias(field), F.count(F.lit(1)).alias("n_reports"))
    return documents.join(last, key, "left").withColumn("n_reports", F.coalesce("n_reports", F.lit(0)))


def history(events: DataFrame, key: str, order: str, fields: list[str], most: int = 20) -> DataFrame:
    """The newest ``most`` entries of each key as an array, newest first; equal times by the fields. The
    limit on the rank is applied in the tasks before the shuffle, however many entries a key has."""
    entry = F.struct(F.col(order), *fields)
    newest = Window.partitionBy(key).orderBy(F.desc("e"))
    ranked = events.select(F.col(key), entry.alias("e")).withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= most)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("e"), asc=False).alias("history"))


def stand_in_report(rows: DataFrame, key: str, drug: str, verdict: str) -> DataFrame:
    """A report from verdicts alone, for where no other is at hand: one sentence and counts."""
    n = lambda v: F.count(F.when(F.col(verdict) == v, 1))
    g = rows.groupBy(key).agg(n("likely_to_fail").alias("n_fail"), n("likely_to_work").alias("n_work"), n("no_call").alias("n_no_call"), F.sort_array(F.collect_set(F.when(F.col(verdict) == "likely_to_work", F.col(drug)))).alias("work"))
    text = F.concat(F.format_string("%d likely to fail, %d likely to work, %d without a call.", "n_fail", "n_work", "n_no_call"), F.when(F.size("work") > 0, F.concat(F.lit(" May work: "), F.array_join("work", ", "), F.lit("."))).otherwise(F.lit("")))
    return g.withColumn("summary", text)


def genome_documents(genomes: DataFrame, parts: dict[str, tuple[DataFrame, str | None, list[str]]], key: str, fields: list[str]) -> DataFrame:
    """``key, value``: one JSON document for each genome, to be written as lines or files of their own.

    A document has the genome's ``fields``, and for each of ``parts`` (name -> rows with ``key``, an
    inner key, fields) an object from inner key to fields, or without an inner key a list, sorted.
    A genome without rows of a part has an empty one; a null field is left out. Rows of a part are
    put together where they are before they travel, one part at a time.
    """
    out, named = genomes.select(F.col(key).alias("__k"), *fields), []
    for name, (rows, inner, columns) in parts.items():
        value = F.struct(*columns)
        entry = F.struct(F.col(inner).cast("string").alias("key"), value.alias("value")) if inner else value
        listed = F.array_sort(F.collect_list(entry))
        got = rows.groupBy(F.col(key).alias("__k")).agg((F.map_from_entries(listed) if inner else listed).alias(name))
        out = out.join(got, "__k", "left").withColumn(name, F.coalesce(name, (F.create_map() if inner else F.array()).cast(dict(got.dtypes)[name])))
        named.append(name)
    return out.select(F.col("__k").alias(key), F.to_json(F.struct(*fields, *named)).alias("value"))
