"""Queries of the joins of similar things that neither gather a side nor compare every block with every block."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.functions import sequence as Q
from phenospark.operators import gates, linkage, minimizers, pivots, signature_join

from .queries import _DNA_SQL, _SIGNATURE_SQL, _dna, _signatures, kmer_callability_all, query, r6
from .tables import EDGE_COSINE, EDGES_SQL, table


@query("similar_pairs", f"WITH {EDGES_SQL} SELECT a, b, round(cosine, 6) AS cosine FROM edges")
def similar_pairs(spark, d):
    found = pivots.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", EDGE_COSINE)
    return found.select("a", "b", r6("cosine", "cosine"))


@query("linkage_rounds")
def linkage_rounds(spark, d):
    """Clusters of all vectors, labels apart, merged in rounds until few are left; the smallest member names each."""
    return linkage.by_rounds(table(spark, d, "embeddings"), "label", "vec_id", "embedding", cut=0.62, tail=200)


#: Documents count as one genome's copies up to this distance.
MASH_DISTANCE = 0.012
MASH_LEAST = signature_join.least_agreement(MASH_DISTANCE, 21, 128)


@query(
    "mash_pairs",
    f"""WITH {_SIGNATURE_SQL}, c AS (SELECT min(doc_id) AS rep, count(*) AS copies, sig FROM sig GROUP BY sig),
p AS (SELECT a.rep AS a, b.rep AS b, a.copies AS copies_a, b.copies AS copies_b, list_sum(list_transform(range(1, 129), lambda i: CAST(a.sig[i] = b.sig[i] AS INT))) AS agree FROM c a JOIN c b ON a.rep < b.rep)
SELECT a, b, copies_a, copies_b, CAST(agree AS BIGINT) AS agree, round(greatest(0, -ln(2 * (agree / 128.0::DOUBLE) / (1 + agree / 128.0::DOUBLE)) / 21), 6) AS distance FROM p WHERE agree >= {MASH_LEAST}""",
)
def mash_pairs(spark, d):
    of = signature_join.classes(_signatures(spark, d), "doc_id", "sig")
    found = signature_join.agreeing_pairs(of, MASH_LEAST)
    copies = of.select("rep", "copies")
    named = found.join(copies.toDF("a", "copies_a"), "a").join(copies.toDF("b", "copies_b"), "b")
    return named.select("a", "b", "copies_a", "copies_b", F.col("agree").cast("long").alias("agree"), r6(Q.mash_distance(F.col("agree") / 128, 21), "distance"))


_PANEL_SQL = f"""{_DNA_SQL}, b AS (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark),
k AS (SELECT DISTINCT item_id, substr(seq, i, 31) AS kmer FROM b, unnest(range(1, length(seq) - 30 + 1, greatest(1, (length(seq) - 31) // 48))) t(i)),
z AS (SELECT item_id, count(*) AS size FROM k GROUP BY ALL),
probes AS (SELECT item_id, 'fwd' AS strand, kmer FROM k UNION SELECT item_id, 'rc', reverse(translate(kmer, 'ACGTN', 'TGCAN')) FROM k),
hit AS (SELECT DISTINCT doc_id, item_id, strand, kmer FROM (SELECT doc_id, substr(seq, i, 31) AS kmer FROM dna, unnest(range(1, length(seq) - 30 + 1)) t(i)) JOIN probes USING (kmer)),
best AS (SELECT doc_id, item_id, max(n) AS n FROM (SELECT doc_id, item_id, strand, count(*) AS n FROM hit GROUP BY ALL) GROUP BY ALL)"""


def _panel(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("contig"), Q.to_dna(F.col("text")).alias("seq"))
    return gates.reference_kmers(b, b.select(F.col("contig").alias("locus"), "contig", F.lit(1).alias("start"), F.length("seq").alias("stop")))


@query("kmer_panel_shares", f"WITH {_PANEL_SQL} SELECT doc_id, CAST(item_id AS VARCHAR) AS locus, round(n / size, 4) AS share FROM best JOIN z USING (item_id)")
def kmer_panel_shares(spark, d):
    """Every item is a locus; pairs without a common k-mer have no row (kmer_callability_all gives them 0)."""
    return minimizers.kmer_shares(_dna(spark, d), "doc_id", _panel(spark, d))


#: It has a row for every document and item with a probe.
query(
    "kmer_callability_all",
    f"""WITH {_PANEL_SQL}
SELECT doc_id, CAST(item_id AS VARCHAR) AS locus, round(coalesce(n, 0) / size, 4) AS share FROM (SELECT doc_id FROM documents) CROSS JOIN z LEFT JOIN best USING (doc_id, item_id)""",
)(kmer_callability_all)
