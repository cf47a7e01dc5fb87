"""Pairs of similar entities."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions import constants as K
from phenospark.storage import materialize

from . import graph

#: Blocks of a join of all with all. So many make enough groups for a cluster; more only where a block would be beyond BLOCK_BYTES.
BLOCKS, BLOCK_BYTES = 16, 32 << 20


def blocks_of(rows: int, width: int, block: int) -> int:
    """How many blocks ``rows`` vectors of ``width`` numbers are dealt to, of about ``block`` rows or more."""
    return max(1, min(-(-rows // block), max(BLOCKS, -(-rows * width * 8 // BLOCK_BYTES))))


def near_pairs(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, dot product) of the pairs that reach ``least``; rows have at most length 1.

    Single precision finds those that may, with room for its rounding; their products are then made in double.
    """
    room = 1e-6 * (a.shape[1] + 10)
    i, j = np.nonzero(a.astype(np.float32) @ b.astype(np.float32).T >= np.float32(least - room))
    dot = np.empty(len(i))
    for s in range(0, len(i), 100_000):
        dot[s : s + 100_000] = np.einsum("ij,ij->i", a[i[s : s + 100_000]], b[j[s : s + 100_000]])
    keep = dot >= least
    return i[keep], j[keep], dot[keep]


def near_links(x: np.ndarray, one: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows ``a`` and ``b`` of ``x`` that near_pairs() finds; ``one`` is ``x`` in single precision.

    Products are made in double only where single precision can't tell.
    """
    room = 1e-6 * (x.shape[1] + 10)
    dot = (one[a] @ one[b].T).ravel()
    at = np.flatnonzero(dot >= np.float32(least - room))
    i, j = a[at // len(b)], b[at % len(b)]
    sure = dot[at] >= np.float32(least + room)
    unsure = np.flatnonzero(~sure)
    for s in range(0, len(unsure), 100_000):
        u = unsure[s : s + 100_000]
        sure[u] = np.einsum("ij,ij->i", x[i[u]], x[j[u]]) >= least
    return i[sure], j[sure]


def linked_parts(x: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """For each row of ``x`` the first row of its part, by the pairs of ``left`` and ``right`` that reach ``least``.

    Both are all different rows, or they are the same. Strips of either side meet what is left of the other. Two
    rows of the largest part so far need not be compared, so where most rows hang together, few strips are enough.
    """
    to, one, same, width = np.arange(len(x)), x.astype(np.float32), left is right, 256
    for s in range(0, max(len(left), len(right)), width):
        turns = [(left[s : s + width], right[s:])] if same else [(left[s : s + width], right[s:]), (right[s : s + width], left[s + width :])]
        for strip, others in turns:
            largest = np.bincount(to).argmax()
            inside = to[strip] == largest
            for a, b in ((strip[inside], others[to[others] != largest]), (strip[~inside], others)):
                for w in range(0, len(b) if len(a) else 0, 8192):
                    graph.link(to, *near_links(x, one, a, b[w : w + 8192], least))
    return to


def _in_blocks(vectors: DataFrame, id_col: str, vector: str, block: int, keep: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """(``id, v, keep_c, at, i, j``: rows once for each pair of blocks (i, j) that they go to, whether ids are repeated)."""
    exact = F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")  # single numbers are half the bytes
    rows = vectors.select(F.col(id_col).alias("id"), exact.alias("v"), *(F.col(c).alias(f"keep_{c}") for c in keep)).filter(F.col("v").isNotNull())
    n, different, width = rows.agg(F.count(F.lit(1)), F.count_distinct("id"), F.max(F.size("v"))).first()
    blocks = blocks_of(n, width or 1, block)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("at", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.select(*rows.columns, "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")), different != n


def _sides(key: tuple[pa.Scalar, ...], t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of length 1, rows of the one block, rows of the other) of a group of _in_blocks(); of a block with itself the same array twice."""
    x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    at = t["at"].to_numpy()
    left = np.flatnonzero(at == key[0].as_py())
    return x, left, left if key[0] == key[1] else np.flatnonzero(at == key[1].as_py())


def cosine_links(vectors: DataFrame, id_col: str, vector: str, least: float, block: int = 2048) -> DataFrame:
    """``a, b``: links that leave the same connected components as all pairs of cosine_edges().

    Each pair of blocks gives stars of what hangs together in it, fewer than it has rows, however many pairs there are.
    """
    dealt, _ = _in_blocks(vectors, id_col, vector, block)
    kind = dict(vectors.dtypes)[id_col]

    def stars(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        to = linked_parts(*_sides(key, t), least)
        node = np.flatnonzero(to != np.arange(len(to)))
        yield pa.RecordBatch.from_arrays([t["id"].take(pa.array(k)).combine_chunks() for k in (node, to[node])], names=["a", "b"])

    return dealt.groupBy("i", "j").applyInArrow(stars, f"a {kind}, b {kind}").filter("a != b")


def cosine_edges(vectors: DataFrame, id_col: str, vector: str, least: float, block: int = 2048, keep: Sequence[str] = (), apart: str | None = None) -> DataFrame:
    """``a, b, cosine`` with a < b for all pairs that reach ``least``.

    Exact all-pairs work is quadratic; here it is matrix products of blocks. Rows are dealt to blocks
    by hash, each pair of blocks is one group, and only pairs that reach the threshold leave it. So
    a task holds two blocks, and a row travels once for each block, of which there are at most
    ``BLOCKS`` until they are large. Each of ``keep`` gives two columns, ``c_a`` and ``c_b``, so what
    is known of the ends need not be joined to the pairs. With ``apart``, one of ``keep``, only pairs
    whose ends differ in it are compared; null differs from nothing.
    """
    kinds = dict(vectors.dtypes)
    dealt, repeated = _in_blocks(vectors, id_col, vector, block, keep)
    kind = kinds[id_col]
    ends = [(f"keep_{c}", kinds[c]) for c in keep]

    def meetings(t: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, rows, whether these are the same and of two of them the pair counts once)."""
        if apart is None:
            yield left, right, right is left
            return
        mark = t[f"keep_{apart}"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        for m in np.unique(mark[left][mark[left] >= 0]):
            other = mark[right] > m if right is left else (mark[right] != m) & (mark[right] >= 0)
            yield left[mark[left] == m], right[other], False

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        x, *sides = _sides(key, t)
        for left, right, same in meetings(t, *sides):
            step = max(1, (1 << 21) // max(1, len(right)))
            for s in range(0, len(left) if len(right) else 0, step):
                after = s + 1 if same else 0
                p, q, dot = near_pairs(x[left[s : s + step]], x[right[after:]], least)
                if same:
                    p, q, dot = p[q >= p], q[q >= p], dot[q >= p]
                a, b = pa.array(left[s + p]), pa.array(right[after + q])
                for u in range(0, len(p), 500_000):
                    o, w = a.slice(u, 500_000), b.slice(u, 500_000)
                    cols = [t["id"].take(o), t["id"].take(w), pa.chunked_array([pa.array(dot[u : u + 500_000])]), *(t[c].take(k) for c, _ in ends for k in (o, w))]
                    yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in cols], names=["a", "b", "cosine", *(f"{c}_{k}" for c, _ in ends for k in "ab")])

    raw = dealt.groupBy("i", "j").applyInArrow(pairs, ", ".join([f"a {kind}, b {kind}, cosine double", *(f"`{c}_{k}` {t}" for c, t in ends for k in "ab")]))
    if repeated:
        raw = raw.filter("a != b")
    less = F.col("a") < F.col("b")
    sides = [F.when(less, F.col(f"keep_{c}_{k}")).otherwise(F.col(f"keep_{c}_{m}")).alias(f"{c}_{k}") for c in keep for k, m in ("ab", "ba")]
    found = raw.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine", *sides)
    return found.dropDuplicates(["a", "b"]) if repeated else found


def strong_edges(edges: DataFrame, ref: str, query: str, ani: str, af_ref: str, af_query: str, least_ani: float = K.ANI, least_af: float = K.ALIGNED_FRACTION) -> DataFrame:
    """Edges whose identity and both aligned fractions are high enough; none from a node to itself."""
    return edges.filter((F.col(ref) != F.col(query)) & (F.col(ani) >= least_ani) & (F.least(af_ref, af_query) >= least_af))


def nearest_in_train(edges: DataFrame, train: DataFrame, nodes: DataFrame, a: str, b: str, score: str, node: str, far: float = 100.0) -> DataFrame:
    """``node, distance``: ``far`` minus the highest score of an edge to another training node, else ``far``."""
    e = edges.filter(F.col(a) != F.col(b))
    t = train.select(F.col(node).alias("__t"))
    one = e.join(t, e[a] == t["__t"], "left_semi").select(F.col(b).alias("g"), F.col(score).alias("s"))
    two = e.join(t, e[b] == t["__t"], "left_semi").select(F.col(a).alias("g"), F.col(score).alias("s"))
    best = one.unionByName(two).groupBy("g").agg(F.max("s").alias("s"))
    return nodes.select(F.col(node).alias("node")).join(best, F.col("node") == F.col("g"), "left").select("node", (F.lit(far) - F.coalesce("s", F.lit(0.0))).alias("distance"))


def nearest_of_marked(edges: DataFrame, nodes: DataFrame, a: str, b: str, score: str, mark: str, node: str, far: float = 100.0) -> DataFrame:
    """nearest_in_train() of edges, none from a node to itself, that know of both ends if they are training nodes: ``mark_a, mark_b``."""
    ends = F.array(F.struct(F.col(a).alias("g"), F.col(f"{mark}_b").alias("t")), F.struct(F.col(b).alias("g"), F.col(f"{mark}_a").alias("t")))
    best = edges.select(F.explode(ends).alias("x"), F.col(score).alias("s")).filter("x.t").groupBy(F.col("x.g").alias("g")).agg(F.max("s").alias("s"))
    return nodes.select(F.col(node).alias("node")).join(best, F.col("node") == F.col("g"), "left").select("node", (F.lit(far) - F.coalesce("s", F.lit(0.0))).alias("distance"))


def average_linkage(distances: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers of an average-linkage tree cut at ``cut``; for one bounded matrix."""
    n = len(distances)
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    while alive.sum() > 1:
        live = np.flatnonzero(alive)
        sub = d[np.ix_(live, live)]
        k = int(sub.argmin())
        i, j = live[k // len(live)], live[k % len(live)]
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == label[j]] = label[i]
    return np.unique(label, return_inverse=True)[1]


def vector_average_linkage(vectors: np.ndarray, cut: float, size: np.ndarray | None = None) -> np.ndarray:
    """average_linkage() over cosine distances of all pairs of rows, without their matrix.

    With ``size`` rows are clusters already, with the mean of their unit vectors. The mean distance of two clusters is 1 minus the product of their mean unit vectors, so a cluster
    is its mean and its size. Chains of nearest neighbours give the same tree as always merging the
    nearest pair, as a merge never brings a cluster nearer to a third. Memory is in proportion to the
    rows, time to their square.
    """
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300) if size is None else vectors.copy()
    n = len(x)
    # Rows 0 to live-1 are the clusters that can still merge; ``of`` is the label of each.
    size = np.ones(n) if size is None else size.astype(float)
    of, parent, live = np.arange(n), np.arange(n), n
    chain: list[int] = []
    while live > 1:
        if not chain:
            chain.append(live - 1)
        top = chain[-1]
        near = x[:live] @ x[top]
        near[top] = -np.inf
        best = int(near.argmax())
        if len(chain) > 1 and near[chain[-2]] >= near[best] - 1e-12:  # equal but for rounding: no cycles
            best = chain[-2]
        gone = top
        if 1 - near[best] > cut + 1e-12:
            # Beyond the cut for good: merges of others don't bring them nearer to this one.
            chain.pop()
        elif len(chain) > 1 and best == chain[-2]:
            del chain[-2:]
            x[best] = (size[best] * x[best] + size[top] * x[top]) / (size[best] + size[top])
            size[best] += size[top]
            parent[of[top]] = of[best]
        else:
            chain.append(best)
            continue
        live -= 1
        if gone != live:  # the last one moves to the free place
            x[gone], size[gone], of[gone] = x[live], size[live], of[live]
            chain = [gone if c == live else c for c in chain]
    for i in range(n):
        r = i
        while parent[r] != r:
            r = parent[r]
        while parent[i] != r:
            parent[i], i = r, parent[i]
    return np.unique(parent, return_inverse=True)[1]


def sparse_average_linkage(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray, cut: float) -> np.ndarray:
    """average_linkage() where pairs that aren't given are at distance 1, without the matrix.

    Two clusters hold the sum of 1 minus distance over their given pairs; those without one stay at
    distance 1. Memory is in proportion to the pairs.
    """
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for p, q, w in zip(a.tolist(), b.tolist(), distance.tolist()):
        links[p][q] = links[q][p] = 1 - w
    size, label = [1] * n, np.arange(n)
    mean = lambda p, q: 1 - links[p][q] / (size[p] * size[q])
    heap = [(mean(p, q), p, q) for p in range(n) for q in links[p] if p < q and mean(p, q) <= cut]
    heapq.heapify(heap)
    while heap:
        d, p, q = heapq.heappop(heap)
        if q not in links[p] or d != mean(p, q):
            continue
        for k, w in links[q].items():
            del links[k][q]
            if k != p:
                links[p][k] = links[k][p] = links[p].get(k, 0.0) + w
        links[q] = {}
        size[p] += size[q]
        label[q] = p
        for k in links[p]:
            d = mean(p, k)
            if d <= cut:
                heapq.heappush(heap, (d, min(p, k), max(p, k)))
    for i in range(n):  # a label points to a smaller node or to itself
        label[i] = label[label[i]]
    return np.unique(label, return_inverse=True)[1]


def linkage_clusters(pairs: DataFrame, group: str, a: str, b: str, distance: str, cut: float = 0.05, largest: int = 5000) -> DataFrame:
    """``group, node, cluster`` by average linkage within each group (e.g. a connected component of
    pairs below a looser cut). A missing pair is at distance 1. A group beyond ``largest`` nodes, whose
    matrix would not fit a task, is clustered over its given pairs alone, with the same result for a
    cut below 1."""
    if cut >= 1:
        raise ValueError("at a cut of 1 pairs that aren't given would merge")
    kind, gkind = dict(pairs.dtypes)[a], dict(pairs.dtypes)[group]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, y, v = t[a].to_pylist(), t[b].to_pylist(), t[distance].to_numpy()
        names = sorted(set(x) | set(y))
        at = {n: i for i, n in enumerate(names)}
        p, q = np.array([at[n] for n in x], np.int64), np.array([at[n] for n in y], np.int64)
        if len(names) > largest:
            found = sparse_average_linkage(len(names), p, q, v, cut)
        else:
            m = np.ones((len(names), len(names)))
            m[p, q] = m[q, p] = v
            found = average_linkage(m, cut)
        return pa.table({group: pa.array([key[0].as_py()] * len(names), t.schema.field(group).type), "node": pa.array(names, t.schema.field(a).type), "cluster": pa.array(found, pa.int32())})

    return pairs.groupBy(group).applyInArrow(run, f"{group} {gkind}, node {kind}, cluster int")


def linkage_vectors(rows: DataFrame, group: str, node: str, vector: str, cut: float, largest: int = 5000) -> DataFrame:
    """``group, node, cluster`` of every row by average linkage over the cosine distances of all pairs
    of a group. Groups that are connected components of pairs below a cut no tighter than ``cut``
    give the clusters of the whole table. A null vector is a cluster of its own. Clusters of a group
    are numbered from 0. A group of more than ``largest`` nodes is never one task: its clusters come
    from linkage.by_rounds()."""
    from . import linkage

    kind, gkind = dict(rows.dtypes)[node], dict(rows.dtypes)[group]
    picked = rows.select(F.col(group).alias(group), F.col(node).alias("node"), F.col(vector).cast("array<double>").alias("v"))
    large = materialize(picked.groupBy(group).count().filter(F.col("count") > largest).select(group), "large-groups")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        v = t["v"].combine_chunks()
        known = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
        found = np.arange(t.num_rows) + t.num_rows
        if len(known):
            flat = v.drop_null().flatten().to_numpy(zero_copy_only=False)
            found[known] = vector_average_linkage(flat.reshape(len(known), -1).copy(), cut)
        found = np.unique(found, return_inverse=True)[1]
        return pa.table({group: t[group], "node": t["node"], "cluster": pa.array(found, pa.int32())})

    if not large.head(1):
        return picked.groupBy(group).applyInArrow(run, f"{group} {gkind}, node {kind}, cluster int")
    same = F.col(group).eqNullSafe(F.col("__large"))
    large = large.withColumnRenamed(group, "__large")
    small = picked.join(large, same, "left_anti").groupBy(group).applyInArrow(run, f"{group} {gkind}, node {kind}, cluster int")
    # by_rounds() names a column root, which may be the group's name as well.
    many = picked.join(large, same, "left_semi").withColumnRenamed(group, "__group")
    return small.unionByName(linkage.numbered(linkage.by_rounds(many, "__group", "node", "v", cut, tail=largest), "__group").withColumnRenamed("__group", group))


def minhash_signatures(rows: DataFrame, id_col: str, tokens: str, seeds: list[int]) -> DataFrame:
    """``id, signature``: for each seed the smallest (hash xor seed) over the row's tokens; null for none.

    The same numbers as functions.sequence.minhash(), which is one expression. Here the minima of a row
    are one matrix operation, which is several times faster for a hundred seeds.
    """
    table = np.array(seeds, np.int64)
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            out = []
            for ts in b.column(1).to_pylist():
                h = np.array([known[t] if t in known else known.setdefault(t, int(hashlib.md5(t.encode()).hexdigest()[:15], 16)) for t in ts or ()], np.int64)
                if len(known) > 200_000:
                    known.clear()
                out.append((h[:, None] ^ table).min(0) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "signature"])

    picked = rows.select(F.col(id_col).alias("id"), F.col(tokens).alias("tokens"))
    return picked.mapInArrow(run, f"id {kind}, signature array<long>").withColumnRenamed("id", id_col)


_MD5_SHIFTS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]), 4, 0).reshape(4, 4, 4).reshape(64)
_MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def kmer_md5(seq: bytes, k: int) -> np.ndarray:
    """The first 64 bits of the md5 of the k-mer at each place, all at once; k is 55 at most, so that one block holds it."""
    n = len(seq) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > 55:
        return np.frombuffer(b"".join(hashlib.md5(seq[i : i + k]).digest()[:8] for i in range(n)), ">u8").astype(np.uint64)
    x = np.frombuffer(seq + bytes(4), np.uint8).astype(np.uint32)
    four = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)  # from each place on, little end first
    message = []
    for w in range(16):
        left = k - 4 * w  # bytes of the k-mer from here on; then a bit that ends it, and its length in bits
        if left >= 4:
            message.append(four[4 * w : 4 * w + n])
        elif left >= 0:
            message.append((four[4 * w : 4 * w + n] & np.uint32((1 << 8 * left) - 1) if left else np.zeros(n, np.uint32)) | np.uint32(0x80 << 8 * left))
        else:
            message.append(np.uint32(8 * k if w == 14 else 0))
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, v) for v in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += message[g]
        f += np.uint32(_MD5_ADD[i])
        turn = np.uint32(_MD5_SHIFTS[i])
        a, d, c, b = d, c, b, b + (f << turn | f >> (np.uint32(32) - turn))
    return (a + start[0]).byteswap().astype(np.uint64) << np.uint64(32) | (b + start[1]).byteswap().astype(np.uint64)


def genome_signatures(contigs: DataFrame, genome: str, order: str, seq: str, seeds: list[int], k: int = 31, most: int | None = None) -> DataFrame:
    """``genome, signature``: minima over the k-mers of A, C, G and T of all of a genome's records.

    The k-mers stay in the task that has the record. Null for a genome without a k-mer. Only a given
    ``most`` ends a genome early: records count in their order up to and with the one that brings the
    number of k-mers, a running sum of lengths, to ``most`` or more.
    """
    from pyspark.sql.window import Window

    contigs = contigs.withColumn(seq, F.explode_outer(F.array(seq)))  # made once, where a column's expression would be run for each use
    counted = contigs.select(F.col(genome).alias("g"), F.upper(F.col(seq)).alias("s"))
    if most is not None:
        n = F.greatest(F.length(seq) - (k - 1), F.lit(0))
        before = F.sum(n).over(Window.partitionBy(genome).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        counted = contigs.select(F.col(genome).alias("g"), F.upper(F.col(seq)).alias("s"), F.coalesce(before, F.lit(0)).alias("b")).filter(F.col("b") < most)
    table = np.array(seeds, np.int64)
    kind = dict(contigs.dtypes)[genome]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, found = np.full((b.num_rows, len(table)), np.iinfo(np.int64).max), np.zeros(b.num_rows, bool)
            held: list[tuple[int, bytes]] = []

            def hashed() -> None:
                """The k-mers of what is held, all at once; those that reach over an end don't count."""
                size = np.array([len(p) for _, p in held])
                start = np.cumsum(size) - size
                h = (kmer_md5(b"".join(p for _, p in held), k) >> np.uint64(4)).astype(np.int64)
                ends = np.stack([start, start + size - k + 1], 1).ravel()
                rows = np.array([i for i, _ in held])
                for j, x in enumerate(table):
                    np.minimum.at(best[:, j], rows, np.minimum.reduceat(np.append(h ^ x, np.iinfo(np.int64).max), ends)[::2])
                found[rows] = True
                held.clear()

            fresh = 0
            for i, s in enumerate(b.column(1).to_pylist()):
                for p in (p.encode() for p in re.findall("[ACGT]+", s or "") if len(p) >= k):
                    for at in range(0, len(p) - k + 1, 8192):
                        held.append((i, p[at : at + 8192 + k - 1]))
                        fresh += len(held[-1][1])
                        if fresh >= 16_384:
                            hashed()
                            fresh = 0
            if held:
                hashed()
            out = pa.array([m if f else None for m, f in zip(best, found)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["g", "m"])

    parts = counted.select("g", "s").mapInArrow(run, f"g {kind}, m array<long>")
    minima = [F.min(F.col("m")[i]) for i in range(len(seeds))]
    found = parts.groupBy("g").agg(F.count("m").alias("n"), F.array(*minima).alias("m"))
    return found.select(F.col("g").alias(genome), F.when(F.col("n") > 0, F.col("m")).alias("signature"))


def minhash_pairs(signatures: DataFrame, id_col: str, signature: str, bands: int, rows: int) -> DataFrame:
    """Candidate pairs ``a, b`` that agree in a whole band of their signatures."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(F.col(signature), i * rows + 1, rows)))
    keyed = signatures.select(F.col(id_col).alias("id"), F.explode(keys).alias("key"))
    other = keyed.select(F.col("id").alias("b"), "key")
    return keyed.withColumnRenamed("id", "a").join(other, "key").filter("a < b").select("a", "b").distinct()


def agreement(a: Column, b: Column) -> Column:
    from phenospark.functions.sequence import signature_agreement

    return signature_agreement(a, b)


