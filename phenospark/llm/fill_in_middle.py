"""Fill-in-middle transformation in Spark SQL functions.

A text is cut into units by a pattern. A hash of seed and id gives two cuts and the form. The units
before, between and behind the cuts become prefix, middle and suffix, which are arranged with
sentinels so that the middle comes last. A text that holds a sentinel stays plain, so every output
can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FillInMiddle:
    """``rate`` of 100 texts are rearranged, ``suffix_first`` of 100 of these in the form spm, the others in psm.

    ``unit`` must match every text from end to end; the default cuts it into lines.
    """

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = r"[^\n]*\n|[^\n]+"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if any(not a or i != j and a in b for i, a in enumerate(marks) for j, b in enumerate(marks)):
            raise ValueError(f"sentinels must not be empty or hold one another: {marks}")


def _hash(digest: Column, group: int) -> Column:
    """One of the groups of eight hexadecimal digits, from 0, as an unsigned integer."""
    return F.conv(F.substring(digest, 1 + 8 * group, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: FillInMiddle = FillInMiddle()) -> DataFrame:
    """One row per row: ``id, n, form, prefix_chars, middle_chars, output``.

    ``n`` is the number of units, ``form`` one of plain, psm and spm; lengths are in code points and
    null where the form is plain. A null text is empty, an empty one plain; a null id counts as an
    empty one. Rows are treated each by itself, so repeated rows give repeated rows, and texts of any
    length are taken whole. A cut at the start or the end leaves parts empty; the two may fall
    together. Other columns are not read. An empty table gives an empty result.
    """
    o = options
    base = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.sha2(F.concat(F.lit(f"{o.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256).alias("digest"),
    )
    units = base.select("*", F.regexp_extract_all("text", F.lit(o.unit), F.lit(0)).alias("units"))
    cuts = units.select("*", F.size("units").alias("n"), (_hash(F.col("digest"), 0) % (F.size("units") + 1)).alias("a"), (_hash(F.col("digest"), 1) % (F.size("units") + 1)).alias("b"))
    low, high = F.least("a", "b").cast("int"), F.greatest("a", "b").cast("int")
    held = F.col("text").contains(o.prefix) | F.col("text").contains(o.suffix) | F.col("text").contains(o.middle)
    plain = (F.col("text") == "") | held | (_hash(F.col("digest"), 2) % 100 >= o.rate)
    form = F.when(plain, "plain").when(_hash(F.col("digest"), 3) % 100 < o.suffix_first, "spm").otherwise("psm")

    def joined(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("units", start, size), "")

    parts = cuts.select(
        "id", "text", "n", form.alias("form"),
        joined(F.lit(1), low).alias("head"), joined(low + 1, high - low).alias("body"), joined(high + 1, F.col("n") - high).alias("tail"),
    )
    arranged = {
        "psm": F.concat(F.lit(o.prefix), "head", F.lit(o.suffix), "tail", F.lit(o.middle), "body"),
        "spm": F.concat(F.lit(o.suffix), "tail", F.lit(o.prefix), "head", F.lit(o.middle), "body"),
    }
    moved = F.col("form") != "plain"
    return parts.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n"), "form",
        F.when(moved, F.char_length("head")).cast("long").alias("prefix_chars"), F.when(moved, F.char_length("body")).cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", arranged["psm"]).when(F.col("form") == "spm", arranged["spm"]).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column, options: FillInMiddle = FillInMiddle()) -> Column:
    """The text from ``output`` and ``form`` alone: the sentinels part it, as no part holds one."""
    o = options
    before = F.substring_index(output, o.middle, 1)  # without the middle and its sentinel
    body = F.substring_index(output, o.middle, -1)
    psm = F.concat(F.substring_index(F.substring_index(before, o.suffix, 1), o.prefix, -1), body, F.substring_index(before, o.suffix, -1))
    spm = F.concat(F.substring_index(before, o.prefix, -1), body, F.substring_index(F.substring_index(before, o.prefix, 1), o.suffix, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of every output and of the text that is read back from it."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hexed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexed(F.col("output")).alias("output_sha256"), hexed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents
), hashed AS (
  SELECT *, len(units) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM base
), parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS head, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS body,
         array_to_string(units[greatest(a, b) + 1:n], '') AS tail
  FROM hashed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(body) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || body WHEN 'spm' THEN '<S>' || tail || '<P>' || head || '<M>' || body ELSE text END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE head || body || tail END) AS restored_sha256
FROM parts
"""
