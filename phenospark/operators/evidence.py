"""Rules that say which hits are evidence for which drug."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.functions import constants as K

RULE_SCHEMA = "drug string, rule_ix int, rule string, subtype string, symbol_re string, class_re string, subclass_re string, confidence string, component string, exclude_re string"


def rule_rows(rules: dict | None = None, excluded: dict | None = None) -> list[tuple]:
    rules, excluded = rules or K.EVIDENCE_RULES, K.EVIDENCE_EXCLUDED if excluded is None else excluded
    return [(d, i, *r, excluded.get(d)) for d, rs in rules.items() for i, r in enumerate(rs)]


def map_hits(hits: DataFrame, rules: list[tuple], symbol: str, subtype: str | None, cls: str | None, subclass: str | None) -> DataFrame:
    """Each hit with each drug that a rule of it fits: the first such rule wins.

    Rules are a table of some tens of rows. They become one array literal in the plan: each hit is
    tested against its patterns in place, so nothing is joined or shuffled.
    """
    sym, sub = F.coalesce(F.col(symbol), F.lit("")), F.upper(F.trim(F.coalesce(F.col(subtype), F.lit("")))) if subtype else None
    of = lambda c: F.coalesce(F.col(c), F.lit(""))
    per_drug = []
    for drug in dict.fromkeys(r[0] for r in rules):
        own = [r for r in rules if r[0] == drug]
        chosen = None
        for _, ix, rule, kind, s_re, c_re, k_re, confidence, component, _ in own:
            fits = F.lit(True)
            if kind == "AMR" and sub is not None:
                fits = fits & (sub == "AMR")
            if kind == "POINT" and sub is not None:
                fits = fits & sub.isin(*K.POINT_SUBTYPES)
            for column, pattern in ((sym, s_re), (of(cls) if cls else None, c_re), (of(subclass) if subclass else None, k_re)):
                if pattern is not None and column is not None:
                    fits = fits & column.rlike(pattern)
            row = F.struct(F.lit(drug).alias("drug"), F.lit(ix).alias("rule_ix"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"), F.lit(component or "").alias("component"))
            chosen = F.when(fits, row) if chosen is None else chosen.when(fits, row)
        banned = own[0][9]
        per_drug.append(F.when(sym.rlike(banned), F.lit(None)).otherwise(chosen) if banned else chosen)
    found = F.explode(F.array_compact(F.array(*per_drug))).alias("__e")
    return hits.select("*", found).select(*hits.columns, "__e.drug", "__e.rule_ix", "__e.rule", "__e.confidence", "__e.component")


def resolve_drug(c, aliases: dict | None = None, drugs: list[str] | None = None):
    """Canonical drug of a name or alias; null if unknown."""
    aliases, drugs = aliases or K.DRUG_ALIASES, drugs or list(K.EVIDENCE_RULES)
    key = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for k, v in ({d: d for d in drugs} | aliases).items() for x in (k, v)])
    return known[key]


def citation_family(c):
    """First clause of a citation."""
    return F.trim(F.split_part(c, F.lit(";"), F.lit(1)))


def rule_citations(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """``drug, rule, citations`` of ``rules`` (``drug, rule, refs``): for each reference, in their order, the
    first clause of its citation, else of its title, else the reference itself.

    ``sources`` has ``ref, cite, title``; of a reference given twice the smallest citation counts.
    A rule without references has an empty list.
    """
    one = sources.groupBy("ref").agg(F.min(F.nullif("cite", F.lit(""))).alias("cite"), F.min(F.nullif("title", F.lit(""))).alias("title"))
    each = rules.select("drug", "rule", F.posexplode_outer("refs").alias("place", "ref"))
    named = each.join(one, "ref", "left").withColumn("family", citation_family(F.coalesce("cite", "title", "ref")))
    found = named.groupBy("drug", "rule").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "family")))).alias("x"))
    return found.select("drug", "rule", F.transform("x", lambda x: x["family"]).alias("citations"))


def with_citations(hits: DataFrame, rules: DataFrame, sources: DataFrame) -> DataFrame:
    """``hits`` (with ``drug, rule``) with their rule's ``citations``; an unknown rule has none."""
    return hits.join(rule_citations(rules, sources), ["drug", "rule"], "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))
