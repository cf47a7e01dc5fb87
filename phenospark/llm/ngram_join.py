"""Jaccard join over word n-grams with signature trees.

1. A document becomes a set of n-gram hashes. Documents with the same set are one node.
2. Routing: nodes that agree in a band of min-hashes are brought together, transitively. Bands are
   so many and so short that a pair at the threshold is missed once in 10**8 or less often;
   pairs that share just a passage are hardly ever brought together.
3. Each group is joined by a signature tree. A tree node holds the OR of its members' token bitmaps,
   their range of sizes, and how many tokens the bitmaps hide at most. The tree is traversed against
   itself; a pair of nodes is cut off if the largest possible overlap is too small, or if all the
   members are known to be connected. What is left is compared exactly.
4. Links join nodes to components.

A group larger than a block is split into blocks, so no task gets a whole group; component_links()
says which of them meet.

A node here is a distinct set; a tree node is always called one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from ._common import WordHashes, discard, rolling, slices, small_batches, words, write_few
from .components import UnionFind, components


@dataclass(frozen=True)
class Join:
    """Two sets link when 100 * |A and B| >= percent * |A or B|."""

    shingle: int = 5
    percent: int = 80
    bands: int = 64
    miss: float = 1e-8
    #: Members of a block, and tokens in all of them; larger groups are split.
    block: int = 256
    block_tokens: int = 1_000_000
    leaf: int = 8
    fan: int = 4

    @property
    def rows(self) -> int:
        """Min-hashes in a band: as many as leave a pair at the threshold a chance of ``miss`` to be missed."""
        r, t = 1, self.percent / 100
        while (1 - t ** (r + 1)) ** self.bands <= self.miss and r < 12:
            r += 1
        return r

    @property
    def smallest(self) -> int:
        """A smaller set can only be linked with the same set."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return 100 * overlap >= self.percent * (a + b - overlap)

    def least_overlap(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))


def shingles(raw: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the whole sequence as one."""
    h = hashes.of(words(raw))
    if not len(h):
        return h
    return np.unique(rolling(h, min(k, len(h))) ^ np.uint64(min(k, len(h))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(sets: list[np.ndarray], join: Join) -> np.ndarray:
    """(sets, bands) of 64-bit keys. No set may be empty."""
    rng = np.random.default_rng(20240229)
    n = join.bands * join.rows
    flip = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    mul = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(sets), join.bands), np.uint64)
    at = 0
    while at < len(sets):  # as many sets at once as fit a cache
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 30_000):
            size += len(sets[end])
            end += 1
        x = (_mix(np.concatenate(sets[at:end])) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        y = np.empty_like(x)
        for band in range(join.bands):
            key = np.full(end - at, band, np.uint64)
            for i in range(band * join.rows, (band + 1) * join.rows):
                np.bitwise_xor(x, flip[i], out=y)
                np.multiply(y, mul[i], out=y)
                key = _mix(key ^ np.minimum.reduceat(y, starts).astype(np.uint64)) + np.uint64(band)
            out[at:end, band] = key
        at = end
    return out


def document_sets(docs: DataFrame, id_col: str, text_col: str, join: Join) -> DataFrame:
    """``id, text_hash, n, node, short, bands`` of each row.

    The node (16 bytes) stands for the set, null for the empty one. Its first 8 bytes are its short
    name, which serves in routing alone: there a clash brings more sets together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for b in slices(batches):
            sets = [shingles(t or b"", join.shingle, hashes) for t in b.column("text").to_pylist()]
            node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            short = pa.array([int.from_bytes(x[:8], "little", signed=True) if x else None for x in node], pa.int64())
            large = [i for i, s in enumerate(sets) if len(s) >= join.smallest]
            keys = band_keys([sets[i] for i in large], join) if large else np.zeros((0, join.bands), np.uint64)
            offsets = np.zeros(len(sets) + 1, np.int32)
            offsets[np.array(large, np.int64) + 1] = join.bands
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), short, bands], names=["id", "text_hash", "n", "node", "short", "bands"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, text_hash long, n long, node binary, short long, bands array<long>")


class SignatureTree:
    """Over sets sorted by size. Level 0 has the leaves; each further level joins ``fan`` nodes."""

    def __init__(self, sets: list[np.ndarray], join: Join):
        self.sets, self.join = sets, join
        size = np.array([len(s) for s in sets])
        bits = 512
        while bits < 4 * int(np.median(size)) and bits < 16_384:
            bits *= 2
        maps = np.zeros((len(sets), bits), bool)
        for i, s in enumerate(sets):
            maps[i, _mix(s) & np.uint64(bits - 1)] = True
        self.size = size
        self.packed = np.packbits(maps, axis=1).view(np.uint64)
        self.hidden = size - maps.sum(1)  # tokens whose bit another token of the set has set too
        self.span, self.bitmap, self.low, self.high, self.most_hidden = [], [], [], [], []
        spans = [(a, min(a + join.leaf, len(sets))) for a in range(0, len(sets), join.leaf)]
        below = None
        while True:
            self.span.append(spans)
            if below is None:
                self.bitmap.append(np.array([np.bitwise_or.reduce(self.packed[a:b]) for a, b in spans]))
            else:
                self.bitmap.append(np.array([np.bitwise_or.reduce(below[i : i + join.fan]) for i in range(0, len(below), join.fan)]))
            below = self.bitmap[-1]
            self.low.append([int(size[a:b].min()) for a, b in spans])
            self.high.append([int(size[a:b].max()) for a, b in spans])
            self.most_hidden.append([int(self.hidden[a:b].max()) for a, b in spans])
            if len(spans) == 1:
                return
            spans = [(spans[i][0], spans[min(i + join.fan, len(spans)) - 1][1]) for i in range(0, len(spans), join.fan)]

    def leaf_pairs(self, connected) -> Iterator[tuple[int, int]]:
        """Pairs of leaves that may hold a link. ``connected(a, b)`` cuts off spans a and b."""
        top = len(self.span) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            need = self.join.least_overlap(self.low[level][i], self.low[level][j])
            most = min(self.high[level][i], self.high[level][j])
            if most < need:
                continue
            if i != j:
                shared = int(np.bitwise_count(self.bitmap[level][i] & self.bitmap[level][j]).sum())
                if shared + min(self.most_hidden[level][i], self.most_hidden[level][j]) < need:
                    continue
            if connected(self.span[level][i], self.span[level][j]):
                continue
            if level == 0:
                yield i, j
                continue
            kids = lambda k: range(k * self.join.fan, min((k + 1) * self.join.fan, len(self.span[level - 1])))  # noqa: E731, B023
            stack += [(level - 1, a, b) for a in kids(i) for b in kids(j) if i != j or a <= b]


def tree_join(sets: list[np.ndarray], join: Join, side: list[int] | None = None, every: bool = False) -> list[tuple[int, int, int]]:
    """(i, j, overlap) of linked sets: a spanning forest of the links, or with ``every`` all of them.

    With ``side``, only pairs from different sides are compared.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i].tobytes()[:64]))
    tree = SignatureTree([sets[i] for i in order], join)
    seen, out = UnionFind(), []
    sides = None if side is None or len(set(side)) < 2 else [side[i] for i in order]

    def connected(a: tuple[int, int], b: tuple[int, int]) -> bool:
        if every:
            return False
        r = seen.root(a[0])
        return all(seen.root(i) == r for i in range(*a)) and all(seen.root(i) == r for i in range(*b))

    for u, v in tree.leaf_pairs(connected):
        (a0, a1), (b0, b1) = tree.span[0][u], tree.span[0][v]
        need = -(-join.percent * (tree.size[a0:a1, None] + tree.size[None, b0:b1]) // (100 + join.percent))
        shared = np.bitwise_count(tree.packed[a0:a1, None] & tree.packed[None, b0:b1]).sum(2, dtype=np.int64)
        shared += np.minimum(tree.hidden[a0:a1, None], tree.hidden[None, b0:b1])
        may = (shared >= need) & (np.minimum(tree.size[a0:a1, None], tree.size[None, b0:b1]) >= need)
        for x, y in np.argwhere(may).tolist():
            i, j = a0 + x, b0 + y
            if i >= j and u == v or sides is not None and sides[i] == sides[j] or not every and seen.root(i) == seen.root(j):
                continue
            p, q = tree.sets[i], tree.sets[j]
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            overlap = int((q[at] == p).sum())
            if join.linked(overlap, len(p), len(q)):
                seen.join(i, j)
                out.append((order[i], order[j], overlap))
    return out


def _routes(sets: DataFrame) -> DataFrame:
    """(a, b): short names of nodes that share a band with the smallest of the band.

    In the first pass the tasks combine; in the second only bands that two nodes share are shuffled.
    """
    keyed = sets.select("short", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("short").alias("first"), F.max("short").alias("last")).filter("first != last").select("key", "first")
    shared = write_few(shared, "bands")
    bits = bitmaps.filter_bits(shared.count())
    hits = bitmaps.probe(keyed, F.col("key"), bitmaps.member_filter(shared, "key", bits), bits).filter("__hit").drop("__hit").distinct()
    return hits.join(shared, "key").filter("short != first").select(F.col("short").alias("a"), F.col("first").alias("b"))


def _members(near: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """``node, rep, root, size, blocks, at`` of the nodes that others are routed to.

    ``root`` names the group, ``size`` is its number of nodes, ``at`` the node's block of ``blocks``.
    """
    near = near.withColumnRenamed("node", "short")
    roots = near.select(F.col("root").alias("short"), "root").distinct()
    members = near.unionByName(roots).join(nodes.select("node", "short", "rep", "n"), "short").drop("short")
    groups = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("__t"))
    blocks = F.greatest(F.ceil(F.col("size") / join.block), F.ceil(F.col("__t") / join.block_tokens)).cast("int")
    groups = groups.select("root", "size", blocks.alias("blocks"))
    dealt = members.join(groups, "root")
    return write_few(dealt.select("node", "rep", "root", "size", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("at")), "members")


def _with_tokens(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, join: Join) -> DataFrame:
    """``members`` with ``tokens``. The sets are made again from the texts: other documents pass no
    shuffle, as a filter of ids stops them where they are read."""
    bits = bitmaps.filter_bits(members.count())
    wanted = bitmaps.member_filter(members.select("rep"), "rep", bits)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    own = bitmaps.probe(own, F.col("id"), wanted, bits).filter(F.col("__hit") | F.col("id").isNull()).select("text")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, before = WordHashes(), set()
        for b in slices(batches):
            sets = [shingles(t or b"", join.shingle, hashes) for t in b.column(0).to_pylist()]
            sets = {xxhash.xxh3_128_digest(s.tobytes()): s for s in sets if len(s) >= join.smallest}
            sets = {k: s for k, s in sets.items() if k not in before}
            before = (before if len(before) < 100_000 else set()) | set(sets)
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["node", "tokens"])

    return own.mapInArrow(again, "node binary, tokens binary").join(members.drop("rep"), "node")


def _join_groups(rows: DataFrame, keys: list[str], join: Join, every: bool = False, apart: bool = False) -> DataFrame:
    """Tree joins of the groups of ``keys``: ``a, b, overlap, size_a, size_b``.

    ``rows`` has ``node, tokens, side``: of a group with more than one side, only nodes of different
    sides are compared, and with ``apart`` none of a group with one side. A node may come several times.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "node", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def joined() -> bool:
            return len(held) > 1 and not (apart and len({x[1] for x in held}) == 1)

        def done() -> pa.RecordBatch:
            names = list(held)
            sets = [np.frombuffer(held[x], np.uint64) for x in names]
            links = tree_join(sets, join, [x[1] for x in names], every)
            a, b = [names[i][0] for i, _, _ in links], [names[j][0] for _, j, _ in links]
            n = [[x[2] for x in links], [len(sets[x[0]]) for x in links], [len(sets[x[1]]) for x in links]]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), *(pa.array(x, pa.int64()) for x in n)], names=["a", "b", "overlap", "size_a", "size_b"])

        for batch in slices(batches):
            node, data, side = (batch.column(c).to_pylist() for c in ("node", "tokens", "side"))
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in keys))):
                if k != key:
                    if joined():
                        yield done()
                    key, held = k, {}
                held[node[i], side[i]] = data[i]
        if joined():
            yield done()

    return sorted_.mapInArrow(run, "a binary, b binary, overlap long, size_a long, size_b long").filter("a != b")


def _all_pairs(members: DataFrame, join: Join, every: bool = False) -> DataFrame:
    """Every two blocks of a group meet, so a node travels once for each block."""
    meet = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = members.select("node", "tokens", "root", F.col("at").alias("side"), meet)
    pairs = pairs.select("node", "tokens", "side", "root", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    return _join_groups(pairs, ["root", "low", "high"], join, every)


def _large_groups(members: DataFrame, join: Join, every: bool = False) -> DataFrame:
    """Links of groups of several blocks; ``members`` has ``node, tokens, root, blocks, at, label``.

    All blocks of a group meet as long as they are no more than there are bands; in a larger group
    nodes meet by bands. So a node travels ``bands`` times at most, however large its group is.
    """
    whole = _all_pairs(members.filter(F.col("blocks") <= join.bands), join, every)
    wide = members.filter(F.col("blocks") > join.bands)
    return whole if wide.isEmpty() else whole.unionByName(_bucket_pairs(wide, join, every))


def _bucket_pairs(members: DataFrame, join: Join, every: bool = False) -> DataFrame:
    """Tree joins within the buckets of nodes that agree in a band, for groups too large to be joined
    as a whole: ``a, b, overlap, size_a, size_b`` of linked nodes with different ``label``.

    ``members`` has ``node, tokens, label``. A node takes part only in buckets with two labels or
    more, so at most once for each band; a bucket larger than a block is dealt to blocks, and there
    every two blocks meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.frombuffer(t, np.uint64) for t in b.column("tokens").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(sets)), join.bands))
            size = pa.array(np.repeat([len(s) for s in sets], join.bands).astype(np.int64))
            keys = pa.array(band_keys(sets, join).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([b.column("node").take(at), b.column("label").take(at), keys, size], names=["node", "label", "key", "n"])

    keyed = members.select("node", "label", "tokens").mapInArrow(run, "node binary, label binary, key long, n long")
    keyed = write_few(keyed, "buckets")
    mixed = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    blocks = F.greatest(F.ceil(F.col("c") / join.block), F.ceil(F.col("t") / join.block_tokens)).cast("int")
    mixed = write_few(mixed.select("key", blocks.alias("blocks")), "mixed")
    dealt = keyed.join(mixed, "key").select("node", "label", "key", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("at"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", F.col("label").alias("side"), "key", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"))
    return _join_groups(dealt.join(members.select("node", "tokens"), "node"), ["key", "low", "high"], join, every, apart=True)


#: About so many nodes of a large group stand in each of its blocks, to connect them.
HUBS = 8
#: Blocks of a very large group that are put together where its strays meet all of them.
WIDE = 16


def component_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, join: Join) -> DataFrame:
    """Links (a, b) that connect what all links would connect.

    A group of one block is joined as it is. A larger one takes two rounds. In the first, each block
    is joined in itself, with some hubs that stand in all blocks. What hangs together then, mostly the
    group of copies around the hubs, needs no further comparison in itself. In the second, nodes
    outside their group's largest part, the strays, meet all blocks if they are at most half of the
    group, s of n nodes: each node goes to every block of strays, each stray to every block of nodes.
    In a group of more blocks than there are bands, up to ``WIDE`` of them are put together for that,
    as tokens allow; so a node travels s / (WIDE * block) times, and the rows that move grow with
    s * n / (WIDE * block). If more than half are strays, all the group's blocks meet, and in a group
    of very many blocks the buckets of bands instead (see _large_groups).
    """
    small = _with_tokens(docs, members.filter("blocks = 1"), id_col, text_col, join)
    first = _join_groups(small.select("node", "tokens", "root", F.lit(0).alias("side")), ["root"], join)
    first = write_few(first.select("a", "b"), "links")
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return first
    members = write_few(_with_tokens(docs, large, id_col, text_col, join), "tokens")
    hub = (F.pmod(F.xxhash64("node", F.lit(1)), F.col("size")) < HUBS)
    places = F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("at"))
    own = _join_groups(members.select("node", "tokens", "root", F.lit(0).alias("side"), F.explode(places).alias("at")), ["root", "at"], join)
    own = write_few(own.select("a", "b"), "links")
    first = first.unionByName(own)
    label = components(own).withColumnRenamed("root", "label")
    named = large.join(label, "node", "left").select("node", "root", "blocks", "at", F.coalesce("label", "node").alias("label"))
    named = write_few(named, "parts")
    sizes = named.groupBy("root", "label").agg(F.count(F.lit(1)).alias("k"))
    groups = sizes.groupBy("root").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("k_main"), F.sum("k").alias("k_all"))
    groups = write_few(groups.filter("k_main < k_all").withColumn("few", F.expr("2 * (k_all - k_main) <= k_all")), "groups")
    if groups.isEmpty():
        return first
    tokens = members.select("node", "tokens", "root", "blocks", "at")
    scattered = groups.filter("not few")
    second = []
    if not scattered.isEmpty():
        mixed = named.join(scattered.select("root"), "root").select("node", "label")
        second.append(_large_groups(write_few(members.select("node", "tokens", "root", "blocks", "at").join(mixed, "node"), "scattered"), join))
    size = members.filter(F.col("blocks") > join.bands).groupBy("root").agg(F.sum(F.length("tokens") / 8 / F.col("blocks")).alias("in_block"), F.max("blocks").alias("all"))
    room = F.floor(F.least(F.lit(WIDE), F.col("all") / join.bands, F.lit(2 * join.block_tokens) / F.col("in_block")))
    few = groups.filter("few").join(size.select("root", F.greatest(F.lit(1), room).cast("int").alias("wide")), "root", "left").withColumn("wide", F.coalesce("wide", F.lit(1)))
    stray_blocks = F.ceil((F.col("k_all") - F.col("k_main")) / (join.block * F.col("wide"))).cast("int")
    known = named.join(few.select("root", "main", "wide", stray_blocks.alias("strays")), "root").select("node", "strays", "wide", (F.col("label") != F.col("main")).alias("stray"))
    known = tokens.join(known, "node").withColumns({"at": F.floor(F.col("at") / F.col("wide")).cast("int"), "blocks": F.ceil(F.col("blocks") / F.col("wide")).cast("int")})
    every_stray = known.select("node", "tokens", "root", F.lit(0).alias("side"), "at", F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("with"))
    strays = known.filter("stray").select("node", "tokens", "root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("strays")).cast("int").alias("with"))
    second.append(_join_groups(every_stray.unionByName(strays), ["root", "at", "with"], join))
    for links in second:
        first = first.unionByName(links.select("a", "b"))
    return first


def document_nodes(sets: DataFrame) -> DataFrame:
    """One row per node: ``node, short, rep`` (smallest id), ``n, copies``."""
    return sets.filter(F.col("node").isNotNull()).groupBy("node", "short", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))


HEAVY_SHARE, HEAVY_ROWS = 1 / 1000, 64


def _routed(docs: DataFrame, id_col: str, text_col: str, join: Join) -> tuple[DataFrame, DataFrame, DataFrame]:
    """document_sets() without bands, document_nodes(), and (short name, root) of nodes in a group."""
    full = write_few(document_sets(docs, id_col, text_col, join), "sets")
    sets = write_few(full.drop("bands"), "sets")
    near = components(_routes(full))
    discard(full)  # the bands take more room than all else
    return sets, write_few(document_nodes(sets), "nodes"), near


def _classes(docs: DataFrame, id_col: str, text_col: str, join: Join) -> DataFrame:
    """``id, text_hash, n, node, root, component_id`` of each row; node and root are null for empty sets."""
    with small_batches(docs.sparkSession):
        sets, nodes, near = _routed(docs, id_col, text_col, join)
        # Written first, so that no task needs a Python worker for the trees and another for components.
        links = write_few(component_links(docs, _members(near, nodes, join), id_col, text_col, join), "links")
        linked = components(links)
    rooted = nodes.select("node", "rep", "copies").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Only nodes with a link, and the roots that they lead to, need to be grouped.
    grouped = rooted.join(linked.select("root").distinct(), "root", "left_semi")
    least = grouped.groupBy("root").agg(F.min("rep").alias("least"))
    named = rooted.join(least, "root", "left").select("node", "root", F.coalesce("least", "rep").alias("component_id"), "copies")
    named = write_few(named, "named")
    most = max(HEAVY_ROWS, int(sets.count() * HEAVY_SHARE))
    own = sets.select("id", "text_hash", "n", "node")
    heavy = F.broadcast(named.filter(F.col("copies") > most).drop("copies"))  # fewer than 1 / HEAVY_SHARE rows
    first = own.join(heavy, "node", "left")
    rest = first.filter("root is null and node is not null").drop("root", "component_id").join(named.filter(F.col("copies") <= most).drop("copies"), "node")
    out = first.filter("root is not null or node is null").unionByName(rest)
    return out.withColumn("component_id", F.coalesce("component_id", "id"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """``id, n_shingles, component_id`` for each row: the smallest id that links lead to.

    A-Z count as a-z; words are runs of characters other than ASCII white space. A null text, or one
    without words, has the empty set and is linked with nothing. A null id is never the smallest if
    there is another. Repeated rows are rows of one component. Other columns are not read. An empty table gives an
    empty result.
    """
    return _classes(docs, id_col, text_col, join).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> tuple[DataFrame, DataFrame]:
    """All links and who they hold for: (``a, b, overlap, size_a, size_b`` with the smallest ids of
    two different sets; ``rep, id`` for each row). Copies aren't expanded into pairs.

    Nulls, empty texts and repeated rows are as in ngram_components(): a row with the empty set is its
    own ``rep`` and in no link. Two sets are in one row at most; which of them is ``a`` isn't defined.
    Links between nearly all sets of a large group are as many as its pairs, as is the result then.
    """
    with small_batches(docs.sparkSession):
        sets, nodes, near = _routed(docs, id_col, text_col, join)
        members = write_few(_with_tokens(docs, _members(near, nodes, join), id_col, text_col, join), "tokens")
        small = members.filter("blocks = 1").select("node", "tokens", "root", F.lit(0).alias("side"))
        large = members.filter("blocks > 1").withColumn("label", F.col("node"))
        links = _join_groups(small, ["root"], join, every=True).unionByName(_large_groups(large, join, True))
        links = write_few(links.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}), "links")
    links = links.dropDuplicates(["a", "b"])
    rep = nodes.select("node", "rep")
    pairs = links.join(rep.toDF("a", "rep_a"), "a").join(rep.toDF("b", "rep_b"), "b")
    pairs = pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "overlap", "size_a", "size_b")
    return pairs, sets.select("id", "node").join(rep, "node", "left").select(F.coalesce("rep", "id").alias("rep"), "id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """One document of each component stays: that with the smallest id. All columns are kept.

    If several texts have that id, one of the texts stays; rows that are the same in id and text
    stay or go together. Texts with the empty set stay.
    """
    rows = write_few(_classes(docs, id_col, text_col, join), "classes").filter("node is not null")
    heads = rows.filter(F.col("id").eqNullSafe(F.col("component_id")))
    one = heads.groupBy("root").agg(F.min("text_hash").alias("stays"))
    doubled = heads.select("root", "id", "text_hash").join(one, "root").filter("text_hash != stays").select("id", "text_hash")
    gone = rows.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "text_hash").unionByName(doubled).distinct()
    gone = write_few(gone.select(F.xxhash64("id", "text_hash").alias("__k"), F.col("id").alias("__id"), F.col("text_hash").alias("__text")), "gone")
    bits = bitmaps.filter_bits(gone.count())
    text = F.xxhash64(F.col(text_col).cast("string"))
    keyed = docs.withColumn("__own", text).withColumn("__key", F.xxhash64(F.col(id_col), F.col("__own")))
    keyed = bitmaps.probe(keyed, F.col("__key"), bitmaps.member_filter(gone, "__k", bits), bits)
    same = (F.col("__key") == F.col("__k")) & F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__text"))
    maybe = keyed.filter("__hit").join(gone, same, "left_anti")
    return keyed.filter("not __hit").unionByName(maybe).select(*docs.columns)


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), join=Join(shingle=4, percent=85))
