"""Column functions that normalise text fields, measurements and annotation hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _clean(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def drug_bucket(c: Column) -> Column:
    """Drop the stray letter of a broken encoding, collapse white space, lower-case. Null gives ''."""
    return F.lower(F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("Â"), F.lit("")), r"[ \t\n\x0B\f\r ]+", " ")))


def first_number(c: Column) -> Column:
    """First decimal number in a text, with its sign; null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double")


def mic(value: Column, sign: Column, measurement: Column) -> Column:
    """Struct ``value, sign``: the value field, else the whole measurement field as sign and number."""
    whole = r"^[ \t]*(<=|>=|<|>|=)?[ \t]*([0-9]+(?:\.[0-9]+)?)[ \t]*$"
    m = F.coalesce(measurement, F.lit(""))
    own, other = first_number(value), F.nullif(F.regexp_extract(m, whole, 2), F.lit("")).cast("double")
    said = F.when(own.isNotNull(), F.trim(F.coalesce(sign, F.lit("")))).otherwise(F.regexp_extract(m, whole, 1))
    known = F.when(said.isin("<=", ">=", "<", ">", "="), said).otherwise(F.lit("="))
    return F.when(F.coalesce(own, other).isNotNull(), F.struct(F.coalesce(own, other).alias("value"), known.alias("sign")))


def mic_like(method: Column, platform: Column) -> Column:
    """Whether a laboratory method yields a minimum inhibitory concentration."""
    m, p = _clean(method), _clean(platform)
    return m.contains("mic") | m.isin(*K.MIC_METHODS) | p.rlike("|".join(K.MIC_PLATFORMS))


def standard(c: Column) -> Column:
    s = _clean(c)
    eu, cl = s.contains("eucast"), s.contains("clsi")
    return F.when(eu & cl, "EUCAST+CLSI").when(eu, "EUCAST").when(cl, "CLSI").otherwise(F.trim(F.coalesce(c, F.lit(""))))


def year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(19|20)[0-9]{2}", 0), F.lit("")).cast("int")


def censored_call(value: Column, sign: Column, s_max: Column, r_min: Column) -> Column:
    """1 resistant, 0 susceptible, null undecided, from a measurement that may be a bound.

    A value known to be larger than ``value`` decides for 1 only, one known to be smaller for 0
    only. ``>=`` exactly at ``r_min`` counts as 1, though an exact value there does not.
    """
    return (
        F.when(s_max.isNull() | r_min.isNull() | value.isNull(), F.lit(None).cast("int"))
        .when(sign.isin(">", ">="), F.when(value >= r_min, 1))
        .when(sign.isin("<", "<="), F.when(value <= s_max, 0))
        .when(value > r_min, 1)
        .when(value <= s_max, 0)
    )


def submitted_call(phenotype: Column) -> Column:
    p = _clean(phenotype)
    return F.when(p == "resistant", 1).when(p == "susceptible", 0)


def i_category(std: Column, yr: Column, redefined: int = K.I_REDEFINED) -> Column:
    return (
        F.when((std == "EUCAST") & (yr >= redefined), K.I_CATEGORIES[0])
        .when(std == "EUCAST", K.I_CATEGORIES[1])
        .when(std == "CLSI", K.I_CATEGORIES[2])
        .otherwise(K.I_CATEGORIES[3])
    )


def loose_phenotype(c: Column) -> Column:
    """resistant, susceptible, intermediate or null, from free text. 'Nonsusceptible' is none of them."""
    s = _clean(c)
    non = s.rlike("^non[ -]?(susceptible|sensitive)")
    return (
        F.when(non, F.lit(None).cast("string"))
        .when(s.contains("resistant") & ~s.contains("intermediate") | s.isin("r", "res"), "resistant")
        .when(s.contains("susceptible") | s.contains("sensitive") | s.isin("s", "sus"), "susceptible")
        .when(s.contains("intermediate"), "intermediate")
    )


def species(own: Column, name: Column) -> Column:
    """The species field, else the first two words of the name."""
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), F.array_join(F.slice(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), 1, 2), " "))


def lab_like(source: Column, method: Column, measurement: Column, phenotype: Column) -> Column:
    s, blank = _clean(source), F.lit("")
    measured = (F.coalesce(measurement, blank) != "") | (F.coalesce(method, blank) != "")
    return ~s.rlike("computational|predicted|model") & (F.coalesce(phenotype, blank) != "") & measured


def identifier(c: Column) -> Column:
    """Identifiers stay text: one like 562.144150 loses its last zero as a number."""
    return F.trim(c.cast("string"))


def method_base(method: Column) -> Column:
    """Upper-case; a last X, P or N goes if what is left is a known method."""
    m = F.upper(F.trim(F.coalesce(method, F.lit(""))))
    head = F.substring(m, F.lit(1), F.length(m) - 1)
    known = (*K.FULL_GENE_METHODS, *K.DEGRADED_METHODS, "POINT")
    return F.when(m.rlike("[XPN]$") & head.isin(*known), head).otherwise(m)


def tier(subtype: Column, method: Column) -> Column:
    base = method_base(method)
    point = F.upper(F.trim(F.coalesce(subtype, F.lit("")))).isin(*K.POINT_SUBTYPES) | (base == "POINT")
    return F.when(point, "point").when(base.isin(*K.FULL_GENE_METHODS), "full_gene").when(base.isin(*K.DEGRADED_METHODS), "degraded").otherwise("unknown")


def feature_name(symbol: Column, subtype: Column, method: Column) -> Column:
    t = tier(subtype, method)
    return F.when(t == "point", F.concat(F.lit("POINT:"), symbol)).when(t == "degraded", F.concat(F.lit("DEG:"), symbol)).otherwise(symbol)


def composite_id(*fields: Column) -> Column:
    """Fields trimmed and lower-cased, empty ones as 'na', joined by a bar."""
    return F.concat_ws("|", *[F.coalesce(F.nullif(_clean(f), F.lit("")), F.lit("na")) for f in fields])


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")
