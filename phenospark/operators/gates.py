"""Whether a genome's data allow a call: locus evidence, k-mers, assembly size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions import constants as K
from phenospark.functions.sequence import locus, reverse_complement, spaced_kmers
from phenospark.storage import materialize, spread


def reference_kmers(contigs: DataFrame, loci: DataFrame, k: int = K.KMER, about: int = K.KMERS_PER_LOCUS) -> DataFrame:
    """``locus, strand, kmer`` of donor loci: ``loci`` has ``locus, contig, start, stop``."""
    seqs = loci.join(contigs, "contig").select("locus", locus(F.col("seq"), F.col("start"), F.col("stop")).alias("s"))
    fwd = seqs.select("locus", F.explode(spaced_kmers(F.col("s"), k, about)).alias("kmer"))
    strands = F.explode(F.array(F.struct(F.lit("fwd").alias("strand"), F.col("kmer").alias("kmer")), F.struct(F.lit("rc").alias("strand"), reverse_complement(F.col("kmer")).alias("kmer"))))
    return fwd.select("locus", strands.alias("x")).select("locus", "x.strand", "x.kmer")


_BASES = np.full(256, 4, np.uint64)
_BASES[[ord(c) for c in "ACGT"]] = np.arange(4)


def all_codes(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(two bits a base for the k-mer at every place, whether it has A, C, G and T only); k up to 32, by doubling."""
    x = _BASES[np.frombuffer(seq, np.uint8)]
    if len(x) < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    bad = np.concatenate(([0], np.cumsum(x == 4)))
    code, width = x & np.uint64(3), 1
    for bit in bin(k)[3:]:
        code, width = code[:-width] << np.uint64(2 * width) | code[width:], 2 * width
        if bit == "1":
            code, width = code[:-1] << np.uint64(2) | (x & np.uint64(3))[width:], width + 1
    return code, bad[k:] == bad[:-k]


def kmer_codes(seq: bytes, k: int) -> np.ndarray:
    """The codes of every k-mer of A, C, G and T."""
    code, good = all_codes(seq, k)
    return code[good]


#: Bases that are looked up at once: their codes stay in a core's cache, and memory doesn't follow the sequences.
SLICE = 1 << 18


def _slices(seqs: list[bytes | None], k: int, most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(places in ``seqs``, sequences or overlapping parts of long ones) of about ``most`` bases together."""
    row, part, size = [], [], 0
    for i, s in enumerate(seqs):
        for at in range(0, max(1, len(s or b"") - k + 1), most):
            row.append(i)
            part.append((s or b"")[at : at + most + k - 1])
            size += len(part[-1])
            if size >= most:
                yield row, part
                row, part, size = [], [], 0
    if row:
        yield row, part


class Probes:
    """Which of a panel's k-mers, of A, C, G and T and up to 32 bases, stand in which sequence."""

    def __init__(self, kmers: list[str], k: int):
        codes = np.array([kmer_codes(x.encode(), k)[0] for x in kmers], np.uint64)
        self.k, self.order = k, np.argsort(codes, kind="stable")
        self.codes, self.first, self.n = np.unique(codes[self.order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - min(24, max(12, len(kmers).bit_length() + 6)))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, seqs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``seqs``, place in the panel) of each probe that is there, at least once.

        Nearly all k-mers end at one look at a table of flags; the rest are searched for in the sorted codes.
        """
        rows, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, part in _slices(seqs, self.k, SLICE) if len(self.codes) else ():
            codes, good = all_codes(b"N".join(part), self.k)
            place = np.flatnonzero(self.maybe[self._slot(codes)] & good)
            at = np.minimum(np.searchsorted(self.codes, codes[place]), len(self.codes) - 1)
            same = self.codes[at] == codes[place]
            start = np.cumsum([0] + [len(x) + 1 for x in part[:-1]])
            owner = np.array(row, np.int64)[np.searchsorted(start, place[same], "right") - 1]
            pair = np.unique(owner * len(self.codes) + at[same])
            owner, at = np.divmod(pair, len(self.codes))
            n = self.n[at]
            rows.append(np.repeat(owner, n))
            hits.append(self.order[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return np.concatenate(rows), np.concatenate(hits)


def kmer_share(contigs: DataFrame, genome: str, ref: DataFrame, most: int = 200_000) -> DataFrame:
    """``genome, locus, share`` of the reference k-mers found, on the better strand.

    The probes are taken in blocks of whole loci, of about ``most`` probes each, one scan a block. A
    contig's k-mers become numbers and are looked up all at once where the contig is read; only
    matches leave the scan. Searching a sequence for hundreds of probes one by one, or making a row of
    each k-mer, took 20 times as long.
    """
    ref = ref.select("locus", "strand", "kmer").distinct()
    blocks = max(1, -(-ref.count() // most))
    if blocks > 1:
        ref = materialize(ref, "probes")
    empty = contigs.select(genome, F.lit(None).cast("string").alias("locus"), F.lit(None).cast("double").alias("share")).limit(0)
    out = None
    for i in range(blocks):
        part = ref.filter(F.pmod(F.xxhash64("locus"), F.lit(blocks)) == i) if blocks > 1 else ref
        probes = sorted((r.kmer, r.locus, r.strand) for r in part.collect())
        if probes:
            share = _probe_share(contigs, genome, probes)
            out = share if out is None else out.unionByName(share)
    return empty if out is None else out


def _probe_share(contigs: DataFrame, genome: str, probes: list[tuple[str, str, str]]) -> DataFrame:
    """kmer_share() for one block of (kmer, locus, strand)."""
    forward: dict[str, set[str]] = {}
    for kmer, x, s in probes:
        forward.setdefault(x, set()).update([kmer] if s == "fwd" else [])
    size = {x: len(forward[x]) for x in sorted(forward)}
    k = len(probes[0][0])
    plain = [p for p in probes if len(p[0]) == k <= 32 and set(p[0]) <= set("ACGT")]
    known = set(plain)
    odd = [p for p in probes if p not in known]
    loci, strands = pa.array([p[1] for p in plain + odd], pa.string()), pa.array([p[2] for p in plain + odd], pa.string())
    shared = contigs.sparkSession.sparkContext.broadcast((Probes([p[0] for p in plain], k), [p[0].encode() for p in odd], loci, strands))
    kind = dict(contigs.dtypes)[genome]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel, odd, loci, strands = shared.value
        for b in batches:
            seqs = b.column(1).to_pylist()
            row, hit = panel.find(seqs)
            also = [(i, len(panel.order) + j) for i, seq in enumerate(seqs) for j, x in enumerate(odd) if x in (seq or b"")] if odd else []
            row, hit = np.concatenate([row, np.array([x for x, _ in also], np.int64)]), np.concatenate([hit, np.array([x for _, x in also], np.int64)])
            at = pa.array(hit)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), loci.take(at), strands.take(at), at], names=["g", "locus", "strand", "probe"])

    picked = contigs.select(F.col(genome).alias("g"), F.col("seq").cast("binary").alias("seq"))
    found = picked.mapInArrow(run, f"g {kind}, locus string, strand string, probe long").withColumnRenamed("g", genome)
    n = found.groupBy(genome, "locus", "strand").agg(F.countDistinct("probe").alias("n")).groupBy(genome, "locus").agg(F.max("n").alias("n"))
    # A genome's matches travel as one map, so its row for each locus is made after the join.
    n = n.groupBy(genome).agg(F.map_from_entries(F.collect_list(F.struct("locus", "n"))).alias("hits"))
    sizes = F.array(*[F.struct(F.lit(k).alias("locus"), F.lit(v).alias("size")) for k, v in size.items()])
    j = spread(contigs.select(genome).distinct().join(n, genome, "left"), genome, contigs).select(genome, "hits", F.explode(sizes).alias("x"))
    at = F.try_element_at("hits", F.col("x.locus"))
    return j.select(genome, "x.locus", F.when(at.isNull(), 0.0).otherwise(F.round(at / F.col("x.size"), 4)).alias("share"))


def locus_evidence(hits: DataFrame, genome: str, symbol: str, name: str, subtype: str, loci: list[str]) -> DataFrame:
    """``genome, locus, mutation, wt, unknown``: sorted symbols by what the screen says of them."""
    point = hits.filter(F.col(subtype).startswith("POINT"))
    which = F.explode(F.filter(F.array(*[F.lit(x) for x in loci]), lambda x: F.startswith(F.col(symbol), F.concat(x, F.lit("_")))))
    tagged = point.select(F.col(genome), which.alias("locus"), F.col(symbol).alias("sym"), F.col(name).alias("name"))
    kind = F.when(F.col("name").contains("[WILDTYPE]"), "wt").when(F.col("name").contains("[UNKNOWN]"), "unknown").otherwise("mutation")
    g = tagged.withColumn("kind", kind).groupBy(genome, "locus")
    return g.agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == x, F.col("sym")))).alias(x) for x in ("mutation", "wt", "unknown")])


def assembly_qc(contigs: DataFrame, genome: str, length: Column, low: int = K.QC_BASES[0], high: int | None = K.QC_BASES[1], most: int = K.QC_CONTIGS) -> DataFrame:
    """``genome, total_bp, n_contigs, ok, problem``."""
    g = contigs.groupBy(genome).agg(F.sum(length).alias("total_bp"), F.count(F.lit(1)).alias("n_contigs"))
    size_ok = (F.col("total_bp") >= low) & (F.lit(True) if high is None else F.col("total_bp") <= high)
    count_ok = F.col("n_contigs") <= most
    problem = F.concat_ws("; ", F.when(~size_ok, "length"), F.when(~count_ok, "contigs"))
    return g.withColumn("ok", size_ok & count_ok).withColumn("problem", problem)


def gate_status(genomes: DataFrame, genome: str, loci: list[str], evidence: DataFrame, screened: DataFrame, shares: DataFrame, least: float = K.CALLABLE_SHARE) -> DataFrame:
    """``genome, status, missing``: pass if every locus is seen.

    A locus with evidence is seen. Where the full screen ran (``screened``), its silence counts; else
    enough k-mers do.
    """
    frame = genomes.select(genome).distinct().withColumn("locus", F.explode(F.array(*[F.lit(x) for x in loci])))
    j = frame.join(evidence.select(genome, "locus", F.lit(True).alias("has")), [genome, "locus"], "left")
    j = j.join(screened.select(genome, F.lit(True).alias("full")), genome, "left").join(shares.select(genome, "locus", "share"), [genome, "locus"], "left")
    seen = F.coalesce("has", F.lit(False)) | (F.col("full").isNull() & F.coalesce(F.col("share") >= least, F.lit(False)))
    g = j.groupBy(genome).agg(F.min(seen.cast("int")).alias("__all"), F.sort_array(F.collect_set(F.when(~seen, F.col("locus")))).alias("missing"))
    return g.select(genome, F.when(F.col("__all") == 1, "pass").otherwise("not_callable").alias("status"), "missing")


def gate_without_loci(qc: DataFrame, genome: str) -> DataFrame:
    """Drugs without a curated locus: assembly quality decides between not callable and no evidence."""
    return qc.select(genome, F.when(F.col("ok"), "absence_of_evidence").otherwise("not_callable").alias("status"))


def callability(frame: DataFrame, evidence: DataFrame, shares: DataFrame, genome: str, least: float = K.CALLABLE_SHARE_DEMO) -> DataFrame:
    """``genome, locus, status`` for each row of ``frame`` (genome, locus): a mutation counts first,
    then k-mers; without an assembly (no share) and without a mutation nothing is known."""
    j = frame.join(evidence.select(genome, "locus", "mutation"), [genome, "locus"], "left").join(shares.select(genome, "locus", "share"), [genome, "locus"], "left")
    status = F.when(F.size("mutation") > 0, "mutation_present").when(F.col("share").isNull(), "unknown").when(F.col("share") >= least, "wild_type_intact").otherwise("not_called")
    return j.select(genome, "locus", status.alias("status"), "share")
