"""Which probes are in which genome, for panels of any size: both sides meet by minimizers.

The minimizer of a k-mer is the one of its m-mers that comes first in a hashed order. Equal k-mers have
equal minimizers, and neighbours mostly share theirs, so a sequence falls into runs of k-mers with one
minimizer that travel as one short string. Only runs whose minimizer some probe has leave the scan: a
bitmap of all 4^m m-mers says which, at any size of the panel. Probes travel by their minimizer, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.storage import materialize

from .gates import all_codes, kmer_codes

M = 11
#: Bytes of runs, and probes, that meet in one group.
GROUP_BYTES, GROUP_PROBES = 4_000_000, 200_000


def minimizers(seq: bytes, k: int, m: int = M) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer of the k-mer at each place, whether it has A, C, G and T only)."""
    n = len(seq) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    code, _ = all_codes(seq, m)
    mask = np.uint64(4**m - 1)
    x = (code ^ (code >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    order = (x ^ (x >> np.uint64(29))) & ~mask | code & mask  # by hash; the code itself is below it
    least, width = order, 1  # the least of ``width`` places from each on
    for bit in bin(k - m + 1)[3:]:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if bit == "1":
            least, width = np.minimum(least[:-1], order[width:]), width + 1
    return (least & mask).astype(np.int64), all_codes(seq, k)[1]


def runs(seq: bytes, k: int, wanted: np.ndarray, m: int = M) -> list[tuple[int, int, int]]:
    """(start, end, minimizer) of the parts of a sequence whose k-mers share a minimizer that is ``wanted``."""
    least, good = minimizers(seq, k, m)
    if not len(least):
        return []
    keep = good & wanted[least]
    start = np.flatnonzero(keep & np.concatenate([[True], (least[1:] != least[:-1]) | ~keep[:-1]]))
    end = np.flatnonzero(keep & np.concatenate([(least[1:] != least[:-1]) | ~keep[1:], [True]]))
    return list(zip(start.tolist(), (end + k).tolist(), least[start].tolist()))


def probe_hits(contigs: DataFrame, genome: str, ref: DataFrame, seq: str = "seq") -> DataFrame:
    """``genome, locus, strand, kmer``, distinct: which of the reference k-mers ``ref`` (``locus, strand,
    kmer``, of one length from 11 to 32, of A, C, G and T) stand in which genome.

    One scan of the sequences, of which runs are written once; probes are never gathered. Groups are
    dealt by minimizer; what is heavy in runs or probes is split by hash, and its parts meet in pairs.
    Null and short sequences hold nothing, repeated rows nothing more. Other probes are an error.
    """
    kind = dict(contigs.dtypes)[genome]
    probes = ref.select("locus", "strand", "kmer").filter("kmer is not null").distinct()
    shape = probes.agg(F.min(F.length("kmer")), F.max(F.length("kmer")), F.count(F.when(~F.col("kmer").rlike("^[ACGT]+$"), 1)), F.count(F.lit(1))).first()
    if not shape[3]:
        return contigs.select(genome).limit(0).selectExpr(genome, "cast(null as string) locus", "cast(null as string) strand", "cast(null as string) kmer")
    k = shape[0]
    if shape[1] != k or not M <= k <= 32 or shape[2]:
        raise ValueError(f"probes must be of one length from {M} to 32, and of A, C, G and T")

    def of_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [int(minimizers(x.encode(), k)[0][0]) for x in b.column("kmer").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int32())], names=["locus", "strand", "kmer", "minimizer"])

    probes = materialize(probes.mapInArrow(of_probes, "locus string, strand string, kmer string, minimizer int"), "probes")
    wanted = np.zeros(4**M, bool)
    for r in probes.select("minimizer").distinct().toLocalIterator():  # 4^M at most
        wanted[r.minimizer] = True
    shared = contigs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def of_contigs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            row, part, least = [], [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                for start, end, x in runs(s or b"", k, wanted):
                    row.append(i)
                    part.append(s[start:end])
                    least.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(part, pa.binary()), pa.array(least, pa.int32())], names=["g", "part", "minimizer"])

    picked = contigs.select(F.col(genome).alias("g"), F.col(seq).cast("string").cast("binary").alias("seq"))
    parts = materialize(picked.mapInArrow(of_contigs, f"g {kind}, part binary, minimizer int").distinct(), "runs")
    total = parts.agg(F.sum(F.length("part"))).first()[0] or 0
    buckets = max(1, -(-total // GROUP_BYTES), -(-shape[3] // GROUP_PROBES), 2 * int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("minimizer"), F.lit(buckets)).alias("bucket")
    heavy = parts.groupBy(bucket).agg(F.sum(F.length("part")).alias("bytes")).join(probes.groupBy(bucket).agg(F.count(F.lit(1)).alias("probes")), "bucket")
    heavy = heavy.select("bucket", F.ceil(F.col("bytes") / GROUP_BYTES).cast("int").alias("salts"), F.ceil(F.col("probes") / GROUP_PROBES).cast("int").alias("shares"))
    heavy = materialize(heavy, "buckets")
    left = parts.withColumn("bucket", bucket).join(heavy, "bucket")
    left = left.select("g", "part", "bucket", F.pmod(F.xxhash64("g", "part"), F.col("salts")).alias("salt"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    right = probes.withColumn("bucket", bucket).join(heavy, "bucket")
    right = right.select("locus", "strand", "kmer", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("locus", "strand", "kmer"), F.col("shares")).cast("int").alias("share"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.array([], pa.int64())
        row, hit = empty, empty
        if a.num_rows and b.num_rows:
            text = a["part"].to_pylist()
            codes, good = all_codes(b"N".join(text), k)
            owner = np.repeat(np.arange(len(text)), [len(t) + 1 for t in text])[: len(codes)]
            probe = kmer_codes(b"N".join(x.encode() for x in b["kmer"].to_pylist()), k)
            order = np.argsort(probe, kind="stable")
            kinds, first = np.unique(probe[order], return_index=True)
            at = np.minimum(np.searchsorted(kinds, codes), len(kinds) - 1)
            found = np.flatnonzero(good & (kinds[at] == codes))
            n = np.diff(np.append(first, len(probe)))[at[found]]
            row = pa.array(np.repeat(owner[found], n))
            hit = pa.array(order[np.repeat(first[at[found]] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        out = {genome: a["g"].take(row), **{c: b[c].take(hit) for c in ("locus", "strand", "kmer")}}
        return pa.table(out)

    keys = ["bucket", "salt", "share"]
    schema = f"`{genome}` {kind}, locus string, strand string, kmer string"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema).distinct()


def kmer_shares(contigs: DataFrame, genome: str, ref: DataFrame, seq: str = "seq") -> DataFrame:
    """``genome, locus, share`` of the reference k-mers found, on the better strand, where any is found.

    The shares of gates.kmer_share() that are not 0, which a panel of any size may leave out.
    """
    n = probe_hits(contigs, genome, ref, seq).groupBy(genome, "locus", "strand").agg(F.count(F.lit(1)).alias("n")).groupBy(genome, "locus").agg(F.max("n").alias("n"))
    size = ref.filter("strand = 'fwd'").groupBy("locus").agg(F.count_distinct("kmer").alias("size"))
    return n.join(size, "locus").select(genome, "locus", F.round(F.col("n") / F.col("size"), 4).alias("share"))
