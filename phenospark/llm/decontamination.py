"""Benchmark decontamination by greedy string tiling.

Runs of ``seed`` words that a document shares with a benchmark item are found by a rolling hash
against an index of the items' runs. For each item with enough of them, the longest match of
unmarked words is marked in both texts, again and again, until none has ``seed`` words. The share of
the item's words that are marked is its coverage: passages whose parts come in another order, or
with text between them, are caught like whole ones.
"""

from __future__ import annotations

import heapq
import string
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import WordHashes, materialize, rolling, slices, small_batches

_PUNCTUATION = string.punctuation.encode()
#: Characters of benchmark text in one index; a larger benchmark is taken in several blocks, one scan each.
BLOCK_CHARS = 16_000_000


@dataclass(frozen=True)
class Tiling:
    """An item is found where its coverage reaches ``coverage`` and ``least`` words are marked.

    Items with fewer words than ``least`` must be covered whole; those with fewer than ``seed``
    words, which any text may hold by chance, are found where a document has just their words.
    """

    seed: int = 5
    coverage: float = 0.5
    least: int = 10

    def need(self, words: int) -> int:
        return max(int(np.ceil(self.coverage * words)), min(words, self.least))


def normal_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Sums:
    """Karp-Rabin hashes of any run of a text, from sums of its prefixes."""

    def __init__(self, h: np.ndarray):
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_INVERSE, len(h)), dtype=np.uint64)])
        self.power = _powers(_BASE, len(h) + 1)

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.power[start]


class Index:
    """The runs of ``seed`` words of all items of a block; places are those in all items' words."""

    def __init__(self, items: list[tuple[object, str]], tiling: Tiling, hashes: WordHashes):
        self.tiling = tiling
        self.ids, words, self.short, ends = [], [], defaultdict(list), []
        at, total = [], 0
        for item, text in items:
            w = normal_words(text or "")
            h = hashes.of(w)
            if len(h) >= tiling.seed:
                at.append(np.arange(total, total + len(h) - tiling.seed + 1))
                words.append(h)
                self.ids.append(item)
                total += len(h)
                ends.append(total)
            elif w:
                self.short[b" ".join(w)].append(item)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if ends else self.ends
        self.need = np.array([tiling.need(n) for n in (self.ends - self.starts).tolist()], np.int64)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        runs = rolling(self.words, tiling.seed)[at]
        order = np.argsort(runs, kind="stable")
        self.at, runs = at[order].astype(np.int32), runs[order]
        self.runs, first = np.unique(runs, return_index=True)
        self.first = np.append(first, len(runs))
        self.bits = max(16, int(np.ceil(np.log2(len(runs) * 8 + 1))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.runs >> np.uint64(64 - self.bits)] = True

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the document's runs that the block has, the runs, items that they could cover enough of).

        Takes time and memory in proportion to the document's words and the items' places, however
        often a run stands in either.
        """
        none = np.zeros(0, np.int64)
        r = rolling(h, self.tiling.seed)
        p = np.flatnonzero(self.seen[r >> np.uint64(64 - self.bits)])
        if not len(p) or not len(self.runs):
            return none, none, none
        k = np.searchsorted(self.runs, r[p])
        k[k == len(self.runs)] = 0
        hit = self.runs[k] == r[p]
        p, met = p[hit], np.unique(k[hit])
        if not len(p):
            return none, none, none
        n = self.first[met + 1] - self.first[met]
        q = np.sort(self.at[np.repeat(self.first[met] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        owner = np.searchsorted(self.ends, q, "right")
        step = np.full(len(q), self.tiling.seed)  # words that a run covers before the next one does
        near = np.flatnonzero(owner[1:] == owner[:-1])
        step[near] = np.minimum(step[near], q[near + 1] - q[near])
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        owner = owner[start]
        return p, r[p], owner[np.add.reduceat(step, start) >= self.need[owner]]

    def matches(self, h: np.ndarray, sums: _Sums, p: np.ndarray, runs: np.ndarray, item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the document, place in the item, words) of all maximal matches with one item.

        The item's equal runs are sorted by the word before them. So where a match begins, which is
        where the words before differ, is found without a look at where it goes on.
        """
        start, end = int(self.starts[item]), int(self.ends[item])
        own = self.words[start:end]
        mine, before = rolling(own, self.tiling.seed), _before(own)[: end - start - self.tiling.seed + 1]
        order = np.lexsort((before, mine))
        mine, before = mine[order], before[order]
        kinds, first = np.unique(mine, return_index=True)
        first = np.append(first, len(mine))
        k = np.searchsorted(kinds, runs)
        k[k == len(kinds)] = 0
        hit = kinds[k] == runs
        p, k = p[hit], k[hit]
        befores, rank = np.unique(before, return_inverse=True)
        both = (np.repeat(np.arange(len(kinds)), np.diff(first)) << 32) | rank
        word = _before(h)[p]
        rank = np.searchsorted(befores, word)
        rank[rank == len(befores)] = 0
        same = (befores[rank] == word) & (p > 0)  # these go on from a place before
        low, high, key = first[k], first[k + 1], (k << 32) | rank
        skip_low = np.where(same, np.searchsorted(both, key, "left"), high)
        skip_high = np.where(same, np.searchsorted(both, key, "right"), high)
        starts, ends, at = np.concatenate([low, skip_high]), np.concatenate([skip_low, high]), np.concatenate([p, p])
        n = ends - starts
        p = np.repeat(at, n)
        q = order[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return p, q, self._lengths(sums, len(h), _Sums(own), len(own), p, q)

    def _lengths(self, doc: _Sums, doc_words: int, item: _Sums, item_words: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words match from (p, q) on: bisection by hashes."""
        low = np.full(len(p), self.tiling.seed, np.int64)
        high = np.minimum(doc_words - p, item_words - q)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            fits = doc.of(p[open_], mid) == item.of(q[open_], mid)
            low[open_] = np.where(fits, mid, low[open_])
            high[open_] = np.where(fits, high[open_], mid - 1)
        return low

    def found(self, words: list[bytes], hashes: WordHashes) -> Iterator[tuple[object, int, int, list[tuple[int, int, int]]]]:
        """(item, its words, marked words, tiles) of the items that the document holds, one item at a time."""
        if len(words) < self.tiling.seed:
            for item in self.short.get(b" ".join(words), ()) if words else ():
                yield item, len(words), len(words), [(0, 0, len(words))]
            return
        h = hashes.of(words)
        places, runs, items = self.candidates(h)
        sums = _Sums(h) if len(items) else None
        for k in items.tolist():
            p, q, n = self.matches(h, sums, places, runs, k)
            order = np.lexsort((q, p, -n))
            size = int(self.ends[k] - self.starts[k])
            tiles = greedy_tiles(p[order], q[order], n[order], len(words), size, self.tiling.seed)
            covered = sum(t[2] for t in tiles)
            if covered >= self.need[k]:
                yield self.ids[k], size, covered, tiles


def _before(h: np.ndarray) -> np.ndarray:
    """The word before each place; 0 before the first."""
    return np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h


def _longest(used: np.ndarray) -> int:
    """Of the runs that aren't used."""
    at = np.flatnonzero(np.concatenate([[True], used, [True]]))
    return int(np.diff(at).max()) - 1


def greedy_tiles(p: np.ndarray, q: np.ndarray, n: np.ndarray, doc_words: int, item_words: int, seed: int) -> list[tuple[int, int, int]]:
    """(start in the document, start in the item, words) of tiles, longest first.

    ``p, q, n`` are the maximal matches, longest first. Equally long ones are taken by their place in
    the document, then in the item. It ends when no unmarked run of either text has ``seed`` words.
    """
    used_p, used_q, tiles = np.zeros(doc_words, bool), np.zeros(item_words, bool), []
    rest: list[tuple[int, int, int]] = []
    i = 0
    while i < len(p) or rest:
        head = (-int(n[i]), int(p[i]), int(q[i])) if i < len(p) else None
        if head is None or rest and rest[0] < head:
            size, a, b = heapq.heappop(rest)
        else:
            (size, a, b), i = head, i + 1
        marked = used_p[a : a - size] | used_q[b : b - size]
        if not marked.any():
            used_p[a : a - size] = used_q[b : b - size] = True
            tiles.append((a, b, -size))
            if _longest(used_q) < seed or _longest(used_p) < seed:
                break
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):  # what is left unmarked comes up again, if long enough
            if y - x >= seed:
                heapq.heappush(rest, (x - y, a + x, b + x))
    return tiles


def benchmark_blocks(benchmark: DataFrame, item_id: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[tuple[object, int], str]]]:
    """((id, how often), text) of the different items in blocks of about ``block_chars``: what the driver and a worker hold at once."""
    kinds = benchmark.select(F.col(item_id).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null").groupBy("i", "t").agg(F.count(F.lit(1)).alias("n"))
    total = kinds.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        part = kinds.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else kinds
        yield [((r.i, r.n), r.t) for r in part.collect()]


def _block_by_block(docs: DataFrame, blocks: Iterator[list], tiling: Tiling, step: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """``step`` of each block's index, which is built once and sent to the executors: about 30 bytes a word.

    Every result but the last is written before the next block's index is made, and its index
    freed: a worker and the driver hold one, however many blocks there are.
    """
    waiting: tuple[DataFrame, Broadcast] | None = None
    for items in blocks:
        if waiting:
            with small_batches(docs.sparkSession):
                done = materialize(waiting[0], "block")
            waiting[1].destroy()
            yield done
        index = docs.sparkSession.sparkContext.broadcast(Index(items, tiling, WordHashes()))
        waiting = step(index), index
    if waiting:
        yield waiting[0]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", tiling: Tiling = Tiling(), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it holds: ids, ``item_words, covered, coverage, tiles``.

    A null or empty text, of a document or an item, holds and is nothing; an empty benchmark gives
    no rows. Repeated documents or items give repeated rows. Other columns are not read. A document
    takes memory in proportion to its words and the items' places in the block; items that its words
    could cover enough of are then matched one by one.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = dict(picked.dtypes)["doc_id"], dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_words int, covered int, coverage double, tiles array<struct<doc_start:int,item_start:int,words:int>>"
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)

    def step(index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            tile = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))
            for b in slices(batches):
                row, item, size, covered, tiles = [], [], [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    for (k, times), m, n, t in index.value.found(normal_words(text or ""), hashes):
                        for _ in range(times):
                            row.append(i)
                            item.append(k)
                            size.append(m)
                            covered.append(n)
                            tiles.append([dict(zip(("doc_start", "item_start", "words"), x)) for x in sorted(t)])
                share = [n / m for n, m in zip(covered, size)]
                cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(item, item_type), pa.array(size, pa.int32()), pa.array(covered, pa.int32()), pa.array(share, pa.float64()), pa.array(tiles, tile)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "item_words", "covered", "coverage", "tiles"])

        return picked.mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for part in _block_by_block(docs, benchmark_blocks(benchmark, item_id, item_text, block_chars), tiling, step):
        out = out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", tiling: Tiling = Tiling(), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; one pass for each block of items.

    Nulls, empty texts and repeated rows are as in contamination(): they stay if they hold nothing.
    """
    at, left = docs.columns.index(text_col), docs

    def step(index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in slices(batches):
                clean = [not any(True for _ in index.value.found(normal_words(t or ""), hashes)) for t in b.column(at).cast(pa.string()).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        return left.mapInArrow(run, docs.schema)

    for left in _block_by_block(docs, benchmark_blocks(benchmark, item_id, item_text, block_chars), tiling, step):  # noqa: B007  step() goes on from it
        pass
    return left


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Rows are contaminated documents, with the item and the tiles; clean documents have none."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
