"""Ranked lexical search over dual-sorted wavelet trees.

1. Of each document the occurrences of the asked terms are counted once and kept as a table.
2. Sums over it give the number of documents, their terms and each term's documents: the weights.
3. A task takes its rows in shards. A shard's posting lists, each by falling impact, stand one behind
   the other in one sequence of documents, which a wavelet tree over document places represents: a
   tree node is a range of document ids, and what it holds of a list is still by falling impact. So
   the first posting of each list in a node bounds what a document below can get from it.
4. For an item the tree is walked from the best bound down, all its terms' ranges together, until no
   open node can hold a better document than the k best. They are exact; equal scores go by id.
5. Each task gives its k best of each item; the k best of these are taken in two steps.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ._common import discard, materialize, slices, small_batches


@dataclass(frozen=True)
class Ranking:
    """A document of n terms, N of them with L terms in all: m = 100 - b + (b * n * N) div L.

    A term of weight w that occurs tf times adds w * ((scale * tf) div (1000 * tf + 12 * m)).
    """

    k: int = 20
    b: int = 25
    scale: int = 1_000_000_000

    def weight(self, documents: int, df: np.ndarray) -> np.ndarray:
        return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)

    def impact(self, tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
        m = 100 - self.b + (self.b * n * documents) // max(1, terms)
        return (self.scale * tf) // (1000 * tf + 12 * m)


#: Characters of items that are asked in one pass over the documents, and postings in one tree.
BLOCK_CHARS = 2_000_000
SHARD_POSTINGS = 600_000
#: Tree nodes that are opened at once: few at first, as the best documents close most of the others.
FIRST_NODES, MOST_NODES = 16, 2048
#: Ways that an item's candidates are parted before the last choice.
SALTS = 32

_TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case."""
    return raw.translate(_TERM).split()


class DualSorted:
    """The wavelet tree of one shard, by levels: level l splits at bit l of the document's place, highest first.

    ``zeros[l, i]``: how many of the first i documents of level l go to the lower half. ``impact[l, i]``
    belongs to posting i of level l. Level 0 holds the lists of all terms, one behind the other.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int):
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        self.terms, self.start = np.unique(term, return_index=True)
        self.end = np.append(self.start[1:], len(term))
        self.size, self.levels = len(term), max(1, int(documents - 1).bit_length())
        self.zeros = np.zeros((self.levels, self.size + 1), np.int32)
        self.impact = np.zeros((self.levels + 1, self.size), np.int32)
        self.impact[0] = impact
        for level in range(self.levels):
            low = (doc >> (self.levels - 1 - level)) & 1 == 0
            np.cumsum(low, out=self.zeros[level, 1:])
            order = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
            doc, impact = doc[order], impact[order]
            self.impact[level + 1] = impact

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int = 0, floor_place: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents, best first; equal scores by place.

        Only documents are looked for that score more than ``floor``, or just that at a place before
        ``floor_place``. ``terms`` are sorted and different.
        """
        none = np.zeros(0, np.int64)
        if not self.size:
            return none, none
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        have = (self.terms[at] == terms) & (weight > 0)
        at, weight = at[have], weight[have]
        if not len(at):
            return none, none
        s, e, w = _Rows(np.int64), _Rows(np.int64), _Rows(np.int64)  # ranges of all nodes that were met
        s.add(self.start[at]), e.add(self.end[at]), w.add(weight)
        bound, low, level = _Rows(np.int64), _Rows(np.int64), _Rows(np.int64)  # of nodes
        first, count = _Rows(np.int64), _Rows(np.int64)
        bound.add([(weight * self.impact[0, self.start[at]]).sum()]), low.add([0]), level.add([0]), first.add([0]), count.add([len(at)])
        open_, places, scores, width = np.zeros(1, np.int64), none, none, FIRST_NODES
        rank0, impacts = self.zeros.reshape(-1), self.impact.reshape(-1)
        while len(open_):
            b, x = bound.rows[open_], low.rows[open_]
            better = (b > floor) | ((b == floor) & (x < floor_place))
            open_, b, x = open_[better], b[better], x[better]
            if not len(open_):
                break
            order = np.lexsort((x, -b))
            now, open_ = open_[order[:width]], open_[order[width:]]
            width = min(2 * width, MOST_NODES)
            # Both children of every range of the nodes that are opened.
            n = count.rows[now]
            ranges = np.repeat(first.rows[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner, lev = np.repeat(np.arange(len(now)), n), np.repeat(level.rows[now], n)
            start, end, part = s.rows[ranges], e.rows[ranges], w.rows[ranges]
            start0, end0 = rank0[lev * (self.size + 1) + start].astype(np.int64), rank0[lev * (self.size + 1) + end].astype(np.int64)
            split = self.zeros[lev, self.size]
            child = np.concatenate([2 * owner, 2 * owner + 1])
            start, end = np.concatenate([start0, split + start - start0]), np.concatenate([end0, split + end - end0])
            part, lev = np.concatenate([part, part]), np.concatenate([lev, lev]) + 1
            order = np.argsort(child, kind="stable")
            order = order[end[order] > start[order]]
            child, start, end, part, lev = child[order], start[order], end[order], part[order], lev[order]
            new = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
            b = np.add.reduceat(part * impacts[lev * self.size + start], new)
            up, lev_new = now[child[new] >> 1], lev[new]
            x = low.rows[up] + ((child[new] & 1) << (self.levels - lev_new))
            good = (b > floor) | ((b == floor) & (x < floor_place))
            leaf = good & (lev_new == self.levels)
            if leaf.any():  # one document: the bound is its score
                places, scores = np.concatenate([places, x[leaf]]), np.concatenate([scores, b[leaf]])
                order = np.lexsort((places, -scores))[:k]
                places, scores = places[order], scores[order]
                if len(places) == k and (scores[-1] > floor or scores[-1] == floor and places[-1] < floor_place):
                    floor, floor_place = int(scores[-1]), int(places[-1])
            going = (lev_new < self.levels) & ((b > floor) | ((b == floor) & (x < floor_place)))
            if going.any():
                size = np.diff(np.append(new, len(child)))
                keep = np.repeat(going, size)
                at = len(s) + np.cumsum(size[going]) - size[going]
                open_ = np.concatenate([open_, np.arange(len(bound), len(bound) + going.sum())])
                s.add(start[keep]), e.add(end[keep]), w.add(part[keep])
                bound.add(b[going]), low.add(x[going]), level.add(lev_new[going]), first.add(at), count.add(size[going])
        return places, scores


class _Rows:
    """A growing array."""

    def __init__(self, kind):
        self._all, self._n = np.zeros(64, kind), 0

    def __len__(self) -> int:
        return self._n

    @property
    def rows(self) -> np.ndarray:
        return self._all[: self._n]

    def add(self, more) -> None:
        end = self._n + len(more)
        if end > len(self._all):
            grown = np.zeros(max(end, 2 * len(self._all)), self._all.dtype)
            grown[: self._n] = self.rows
            self._all = grown
        self._all[self._n : end] = more
        self._n = end


# ---------------------------------------------------------------- over tables


def item_blocks(items: DataFrame, item_id: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, bytes, int]]]:
    """Different (id, text) with how often they occur, in blocks of about ``block_chars``: what the driver and a worker hold at once."""
    kinds = items.select(F.col(item_id).alias("i"), F.col(text_col).cast("string").alias("t")).groupBy("i", "t").agg(F.count(F.lit(1)).alias("n"))
    total = kinds.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        part = kinds.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else kinds
        yield [(r.i, r.t.encode(), r.n) for r in part.filter("t is not null").collect()]


def postings(docs: DataFrame, id_col: str, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """``id, n, terms, tfs`` of documents with a term: all their terms, and the numbers and counts of those that are asked."""
    asked = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = asked.value.get
        for b in slices(batches):
            n, parts = [], []
            for i, raw in enumerate(b.column(1).to_pylist()):
                found = terms_of(raw or b"")
                n.append(len(found))
                t = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
                parts.append(t[t >= 0] | i << 32)
            key, tf = np.unique(np.concatenate(parts), return_counts=True)
            ends = np.searchsorted(key, np.arange(len(n) + 1) << 32)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (key & 0xFFFFFFFF, tf)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(n) > 0))

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, n long, terms array<int>, tfs array<int>")


def _order(x) -> tuple:
    """Nulls first."""
    return (x is not None, x) if x is not None else (False, 0)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        while b.num_rows:
            ends = np.asarray(b.column(2).offsets)[1:].astype(np.int64) - b.column(2).offsets[0].as_py()
            fit = max(int(np.searchsorted(ends, most - size, "right")), 0 if held else 1)
            if fit:
                held.append(b.slice(0, fit))
                size += int(ends[fit - 1])
            b = b.slice(fit)
            if b.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", ranking: Ranking = Ranking(), block_chars: int = BLOCK_CHARS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0, all if they are fewer.

    Equal scores go by ascending id, null ids first. A null or empty text, of a document or an item,
    has no term and is in no result. Repeated documents are ranked each; repeated items give repeated
    results. Very long texts are counted whole. Other columns are not read. Empty tables give an empty
    result. Columns are named by ``item_id`` and ``id_col``. Items beyond ``block_chars`` of text are
    taken in several passes over the documents.
    """
    spark, item_type, id_type = docs.sparkSession, items.schema[item_id].dataType, docs.schema[id_col].dataType
    kinds = dict(items.dtypes)[item_id], dict(docs.dtypes)[id_col]
    schema = f"item {kinds[0]}, no int, copies long, doc {kinds[1]}, score long"
    found, open_ = [], None
    for block in item_blocks(items, item_id, item_text, block_chars):
        if open_:  # another pass follows: the postings of this one are not kept
            found.append(materialize(open_[0], "ranked"))
            discard(open_[1])
        asked = [(i, Counter(terms_of(raw)), n) for i, raw, n in block]
        number = {t: j for j, t in enumerate(sorted({t for _, c, _ in asked for t in c}))}
        with small_batches(spark):
            table = materialize(postings(docs, id_col, text_col, number), "postings")
        documents, terms = table.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(number), np.int64)
        for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each asked term
            df[r.t] = r["count"]
        weight = ranking.weight(documents, df)
        plan = []
        for i, c, n in asked:
            t = np.array(sorted(number[x] for x in c), np.int64)
            times = {number[x]: m for x, m in c.items()}
            plan.append((i, n, t, weight[t] * np.array([times[x] for x in t.tolist()], np.int64)))
        shared = spark.sparkContext.broadcast((plan, documents, terms or 0))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            plan, documents, terms = shared.value
            best: list[list[tuple]] = [[] for _ in plan]  # (-score, order of the id, id), sorted
            for rows in _shards(batches, shard_postings):
                rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_start")).combine_chunks()
                ids = rows.column("id").to_pylist()
                lists, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
                each = np.diff(np.asarray(lists.offsets))
                n = np.repeat(rows.column("n").to_numpy(), each)
                impact = ranking.impact(tfs.flatten().to_numpy().astype(np.int64), n, documents, terms)
                tree = DualSorted(lists.flatten().to_numpy(), np.repeat(np.arange(len(ids), dtype=np.int32), each), impact, len(ids))
                order = list(map(_order, ids))
                for j, (_, _, t, w) in enumerate(plan):
                    kept = best[j]
                    limit = (-kept[-1][0], bisect_left(order, kept[-1][1])) if len(kept) == ranking.k else (0, 0)
                    places, scores = tree.best(t, w, ranking.k, *limit)
                    if len(places):
                        new = [(-s, order[p], ids[p]) for p, s in zip(places.tolist(), scores.tolist())]
                        best[j] = sorted(kept + new, key=lambda x: x[:2])[: ranking.k]
            flat = [(i, j, n, x[2], -x[0]) for j, (i, n, _, _) in enumerate(plan) for x in best[j]]
            kind = [to_arrow_type(item_type), pa.int32(), pa.int64(), to_arrow_type(id_type), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], k) for c, k in enumerate(kind)], names=["item", "no", "copies", "doc", "score"])

        top = table.mapInArrow(run, schema).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
        for keys in (["no", "salt"], ["no"]):
            ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc")))
            top = top.withColumn("rank", ranked).filter(F.col("rank") <= ranking.k)
        open_ = top, table
    out = open_[0] if open_ else spark.createDataFrame([], schema + ", rank int")
    for more in found:
        out = out.unionByName(more, allowMissingColumns=True)
    copies = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return copies.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id_col), "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM found GROUP BY ALL),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""
