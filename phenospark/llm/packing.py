"""Best-fit packing of token sequences by vectors of resources.

A piece needs tokens, one document place and attention cost (its length squared). A bin has a
capacity of each. Pieces are placed by falling length. Of the bins with room in every resource, the
one with the least weighted norm of what would be left of all three ("norm"), or with the largest
weighted dot product of residual and need ("dot"), takes the piece; if none has room, a bin is
opened.

The decision depends on lengths alone, and lengths are at most the token capacity. So it is taken
on the histogram of lengths, for all pieces of a length and all bins of a residual at once: the
driver sees a table whose size depends on the capacity, not on the corpus. A piece then finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, slices, small_batches


@dataclass(frozen=True)
class Capacity:
    """Of one bin. All three resources are in every bin's residual and in the rule's value.

    A resource without a number has the most that a bin full of tokens can take: then it can't run
    out, but still weighs on which bin is chosen.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"
    #: Residual places and cost are rounded down to so many steps, which bounds the kinds of bins;
    #: None keeps them exact. Each piece so costs a bin up to 1 / steps of its places and cost beyond
    #: its own, but never more than the tokens used imply: where those two can't run out before the
    #: tokens, rounding closes no bin.
    steps: int | None = 64


@dataclass
class Plan:
    """Row i: pieces of ``length`` with ranks from ``low`` go ``per_bin`` to a sequence, from ``sequence``, from ``offset`` on."""

    length: np.ndarray
    low: np.ndarray
    sequence: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        order = np.int64(1) << 48
        at = np.searchsorted(self.length * order + self.low, length * order + rank, side="right") - 1
        behind = rank - self.low[at]
        return self.sequence[at] + behind // self.per_bin[at], self.offset[at] + behind % self.per_bin[at] * length


class _Kinds:
    """Bins of one residual are a kind: rows of an array, each with runs of (first sequence, number)."""

    def __init__(self) -> None:
        self.residual = np.zeros((1024, 3), np.int64)
        self.alive = np.zeros(1024, bool)
        self.runs: list[list[tuple[int, int]]] = []
        self.row: dict[tuple[int, int, int], int] = {}

    def add(self, key: tuple[int, int, int], run: tuple[int, int]) -> int | None:
        """The row, if it is a new one."""
        at = self.row.get(key)
        if at is not None:
            self.runs[at].append(run)
            return None
        at = self.row[key] = len(self.runs)
        if at == len(self.alive):
            self.residual = np.concatenate([self.residual, np.zeros_like(self.residual)])
            self.alive = np.concatenate([self.alive, np.zeros_like(self.alive)])
        self.residual[at], self.alive[at] = key, True
        self.runs.append([run])
        return at

    def take(self, at: int) -> list[tuple[int, int]]:
        runs, self.runs[at], self.alive[at] = self.runs[at], [], False
        del self.row[tuple(self.residual[at].tolist())]
        return runs

    def compact(self) -> None:
        if len(self.runs) > 2 * len(self.row) + 1024:
            rows = np.flatnonzero(self.alive)
            self.residual, self.runs = self.residual[rows], [self.runs[i] for i in rows.tolist()]
            self.alive = np.ones(len(rows), bool)
            self.row = {tuple(r): i for i, r in enumerate(self.residual.tolist())}


def best_fit(histogram: dict[int, int], capacity: Capacity = Capacity()) -> Plan:
    """Pack ``histogram[length]`` pieces of each length, none longer than a bin.

    Bins of the same value are taken by least residual: tokens, then places, then cost.
    """
    tokens, shortest = capacity.tokens, min(histogram, default=1)
    full = (tokens, tokens // shortest if capacity.documents is None else capacity.documents, tokens**2 if capacity.attention is None else capacity.attention)
    w = np.array(capacity.weights) / np.maximum(1.0, np.array(full, float)) ** 2
    grain = [1, 1, 1] if capacity.steps is None else [1, *(max(1, f // capacity.steps) for f in full[1:])]
    kinds, rows, opened = _Kinds(), [], 0
    by_norm = capacity.rule == "norm"

    def value(residual, need):
        return (w * (residual - need) ** 2).sum(-1) if by_norm else -(w * residual * need).sum(-1)

    def put(residual: tuple[int, ...], run: tuple[int, int]) -> int | None:
        used = tokens - residual[0]
        least = (0, full[1] - used // shortest, full[2] - used * used)
        key = tuple(max(r // g * g, m) for r, g, m in zip(residual, grain, least))
        return kinds.add(key, run) if run[1] and min(key) > 0 else None

    def per_bin(residual: tuple[int, ...], need: tuple[int, ...]) -> int:
        # By norm the bin just used is the best as long as it has room; by dot product it isn't.
        return min(r // x for r, x in zip(residual, need)) if by_norm else 1

    for length in sorted(histogram, reverse=True):
        need = (length, 1, length * length)
        if any(x > f for x, f in zip(need, full)):
            raise ValueError(f"a piece of {length} tokens doesn't fit an empty bin")
        kinds.compact()
        n, rank, need_v = histogram[length], 0, np.array(need, np.int64)
        known = np.flatnonzero(kinds.alive[: len(kinds.runs)] & (kinds.residual[: len(kinds.runs)] >= need_v).all(1))
        room = kinds.residual[known]
        values = value(room, need_v)
        order = np.lexsort((room[:, 2], room[:, 1], room[:, 0], values))
        queue = zip(values[order].tolist(), map(tuple, room[order].tolist()), known[order].tolist())
        fresh: list[tuple] = []  # kinds that came up while this length is placed

        def offer(residual: tuple[int, ...], run: tuple[int, int]) -> None:
            at = put(residual, run)
            if at is not None:
                r = kinds.residual[at]
                if (r >= need_v).all():
                    heapq.heappush(fresh, (float(value(r, need_v)), tuple(r.tolist()), at))

        head = next(queue, None)
        while rank < n:
            best = None
            while head is not None or fresh:
                if fresh and (head is None or fresh[0][:2] <= head[:2]):
                    best = heapq.heappop(fresh)
                else:
                    best, head = head, next(queue, None)
                if kinds.alive[best[2]]:
                    break
                best = None
            if best is None:
                # No other bin has room, so by either rule the new one is the best as long as it has.
                residual, per = full, min(f // x for f, x in zip(full, need))
                count = -(-(n - rank) // per)
                runs, opened = [(opened, count)], opened + count
            else:
                residual, per = best[1], per_bin(best[1], need)
                runs = kinds.take(best[2])
            for first, count in runs:
                left, offset = n - rank, tokens - residual[0]
                whole = min(count, left // per)
                if whole:
                    rows.append((length, rank, first, per, offset))
                    offer(tuple(r - per * x for r, x in zip(residual, need)), (first, whole))
                    rank += whole * per
                part = min(left - whole * per, per - 1) if whole < count else 0
                if part:
                    rows.append((length, rank, first + whole, part, offset))
                    offer(tuple(r - part * x for r, x in zip(residual, need)), (first + whole, 1))
                    rank, whole = rank + part, whole + 1
                if whole < count:
                    put(residual, (first + whole, count - whole))
    rows.sort()
    columns = [np.array([r[i] for r in rows], np.int64) for i in range(5)]
    return Plan(*columns, sequences=opened)


_encoders: dict[str, object] = {}
#: Beyond this, scripts whose classes of characters the two libraries might know from different years.
_PLAIN = "ɏ"


class _Encoder:
    """Ids as the tokenizers library gives them, added tokens included. Its vocabulary's ranks in
    tiktoken give the same ids several times faster; texts with rare scripts, or with the content
    of an added token, go to the slower library itself."""

    def __init__(self, name: str, added: tuple[str, ...]):
        import base64

        import public_tokenizers
        import tiktoken

        self.name, self.added, self._slow = name, added, None
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        if self._slow is None:  # some tens of MB that most workers never need
            import os

            import public_tokenizers
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._slow = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        return self._slow

    def ids(self, text: str) -> np.ndarray:
        if text and (max(text) > _PLAIN or any(t in text for t in self.added)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def added_tokens(name: str) -> tuple[str, ...]:
    """What a tokenizer's file says of tokens that stand for themselves; it takes some tens of MB to read."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", ()))


def encoder(name: str, added: tuple[str, ...] | None = None) -> _Encoder:
    """``added`` spares the worker the reading of added_tokens()."""
    if name not in _encoders:
        _encoders[name] = _Encoder(name, added_tokens(name) if added is None else added)
    return _encoders[name]


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than ``longest``."""
    first = n - (n - 1) // longest * longest
    return [(0, first)] + [(s, longest) for s in range(first, n, longest)]


def pieces(docs: DataFrame, id_col: str, text_col: str, longest: int, tokenizer: str, end_id: int) -> DataFrame:
    added = added_tokens(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, enc = {}, encoder(tokenizer, added)
        for b in slices(batches):
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), longest)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    rank.append(seen.get(n, 0))
                    seen[n] = rank[-1] + 1
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, rank)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *longs, b.column(2).take(pa.array(row, pa.int64()))],
                names=["id", "piece", "start", "length", "ids_crc32", "rank", "part"],
            )

    # The partition that run() is called for: one task calls it for several, where they are put together to few files.
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, rank long, part int")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: Capacity = Capacity(), tokenizer: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document's ids are the tokenizer's and then ``end_id``. Documents longer than a bin are cut.
    A null text is empty and gives one piece of length 1. Very long texts are cut, in as many pieces
    as they need. Repeated rows are packed each; other columns are not read. Which of the pieces of
    one length goes where follows their order in the input; the numbers of sequences and of pieces of
    each length in them don't. An empty table gives an empty result.
    """
    longest = capacity.tokens
    while capacity.attention is not None and longest > 1 and longest**2 > capacity.attention:
        longest -= 1
    with small_batches(docs.sparkSession):
        cuts = materialize(pieces(docs, id_col, text_col, longest, tokenizer, end_id), "pieces")
    # Rank among all pieces of a length: the rank in the partition that it was cut from, after those of earlier ones.
    counts = cuts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "part", F.coalesce(earlier, F.lit(0)).alias("base"))
    histogram = {r.length: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``longest`` rows
    plan = best_fit(histogram, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = plan.place(length, rank)
            cols = [b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cuts.join(base, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    placed = ranked.mapInArrow(run, f"id {dict(cuts.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """2048 tokens; places and cost can't run out before the tokens, but weigh in the choice of a bin."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=Capacity(tokens=2048, documents=2048, attention=2048**2))
