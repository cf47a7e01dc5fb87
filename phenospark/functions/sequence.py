"""Column functions over nucleotide sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def locus(seq: Column, start: Column, stop: Column) -> Column:
    """Positions ``start`` to ``stop``, counted from 1, both included."""
    return F.substr(seq, start, stop - start + 1)


def kmers(seq: Column, k: int, step: Column | int = 1) -> Column:
    """Distinct substrings of length k, one every ``step`` positions; none if the sequence is shorter."""
    return _kmers(seq, k, lambda s: F.lit(step) if isinstance(step, int) else step)


def _kmers(seq: Column, k: int, step: Callable[[Column], Column]) -> Column:
    def of(s: Column) -> Column:
        last = F.length(s) - k + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)), step(s))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substr(s, i, F.lit(k))))

    # As a lambda's variable the sequence is made once; as a column, its whole expression would be run again for each k-mer.
    return F.transform(F.array(seq), of)[0]


def spaced_kmers(seq: Column, k: int = 31, about: int = 48) -> Column:
    """About ``about`` k-mers spread evenly over the sequence."""
    return _kmers(seq, k, lambda s: F.greatest(F.lit(1), F.floor((F.length(s) - k) / about).cast("int")))


def clean_kmers(seq: Column, k: int) -> Column:
    """Distinct k-mers of A, C, G, T only."""
    return F.filter(kmers(F.upper(seq), k), lambda x: x.rlike("^[ACGT]+$"))


def base_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^A-Za-z]|[Nn]", ""))


def gc_percent(seq: Column) -> Column:
    n = base_count(seq)
    return F.try_divide(F.lit(100.0) * F.length(F.regexp_replace(seq, "[^GCgc]", "")), n)


def format_bases(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.format_string("%.2f Mbp", n / 1_000_000.0))
        .when(n >= 1_000, F.format_string("%.1f kbp", n / 1_000.0))
        .otherwise(F.concat(n.cast("string"), F.lit(" bp")))
    )


def to_dna(text: Column) -> Column:
    """Stand-in sequences from prose: letters map to bases, all else goes."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), letters, ("ACGT" * 7)[: len(letters)])


def token_hash(c: Column) -> Column:
    """60 bits of md5; the same in other engines."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def minhash(tokens: Column, seeds: list[int]) -> Column:
    """Signature: for each seed the smallest (hash xor seed); null for no tokens."""
    hashes = F.transform(tokens, lambda t: token_hash(t.cast("binary")))
    table = F.array(*[F.lit(s).cast("long") for s in seeds])
    none = F.transform(table, lambda s: F.lit((1 << 63) - 1))
    # One pass over the tokens; each is hashed once.
    least = F.aggregate(hashes, none, lambda acc, h: F.zip_with(acc, table, lambda a, s: F.least(a, h.bitwiseXOR(s))))
    return F.when(F.size(tokens) > 0, least)


def signature_agreement(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) / F.size(a)


def mash_distance(j: Column, k: int) -> Column:
    return F.when(j <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), -F.log(2 * j / (1 + j)) / k))
