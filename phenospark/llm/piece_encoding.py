"""Encoding to and decoding from SentencePiece pieces, by merge rounds over flat arrays.

The library merges, in a text, the pair of neighbours whose union is the piece of the highest score,
the leftmost of equal ones, until no pair makes a piece. Here all new words of a batch are merged
together. Their symbols lie in one array. In a round the lowest rank of a pair in each word is found
by a segmented minimum, that pair is merged at every place of the word where it stands, from the
left, and the arrays are closed up. A word whose pairs make no piece leaves the arrays.

Where this equals merging one pair after the other:

* A merge never crosses two characters that stand side by side in no piece. So texts fall into words
  at white space, and words into segments, that are merged by themselves.
* If a piece is part of a piece of a higher or the same score, its union with a neighbour may come
  before its own next merge. Of such a piece only the leftmost pair of a word is merged in a round.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices

SPACE = "▁"
_NONE = np.int64(1) << 40  # rank of a pair that makes no piece
_CODE_POINTS = 0x110000


class PieceModel:
    """The pieces of a byte-fallback BPE model whose normalisation only writes spaces as U+2581, one in front.

    A symbol is the id of a piece or, for a character that is none, ``size`` plus its code point.
    Models of another kind are refused.
    """

    #: Words that are remembered, and the longest of them.
    MOST_WORDS, LONGEST = 200_000, 64
    #: What isn't done after so many rounds, parts of words of hundreds of characters, is merged pair by pair.
    MOST_ROUNDS = 256

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        kinds = [(sp.is_control(i) or sp.is_unknown(i), sp.is_byte(i), sp.is_unused(i)) for i in range(self.size)]
        names = [sp.id_to_piece(i) for i in range(self.size)]
        if sum(k[1] for k in kinds) != 256 or any(k[2] for k in kinds) or sp.normalize("ﬁ  A\n") != f"{SPACE}ﬁ{SPACE}{SPACE}A\n":
            raise ValueError("only models with byte fallback, without unused pieces and without normalisation of characters can be read")
        self.byte = np.zeros(256, np.int32)
        for i, (_, is_byte, _) in enumerate(kinds):
            if is_byte:
                self.byte[int(names[i][1:-1], 16)] = i
        normal = {names[i]: i for i, (special, is_byte, _) in enumerate(kinds) if not special and not is_byte}
        self._decoding(names, kinds, sp.decode([sp.unk_id()]))
        self._merging(normal, {i: sp.get_score(i) for i in normal.values()})
        self._splitting(normal)
        self.words: dict[str, int] = {}
        self._forget()

    def _decoding(self, names: list[str], kinds: list[tuple[bool, bool, bool]], unknown: str) -> None:
        """Bytes of each piece, one after the other."""
        surface = [b"" if special else bytes([int(s[1:-1], 16)]) if is_byte else s.replace(SPACE, " ").encode() for s, (special, is_byte, _) in zip(names, kinds)]
        surface[names.index("<unk>") if "<unk>" in names else 0] = unknown.encode()
        self.is_byte = np.array([k[1] for k in kinds])
        self.is_space_first = np.array([s.startswith(SPACE) and not k[0] for s, k in zip(names, kinds)])
        self.is_silent = np.array([not s for s in surface])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len

    def _merging(self, normal: dict[str, int], score: dict[int, float]) -> None:
        """Sorted pairs of symbols with the rank and the symbol of their union."""
        self.of_char = np.arange(self.size, self.size + _CODE_POINTS, dtype=np.int32)
        for s, i in normal.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.of_char[ord(" ")] = self.of_char[ord(SPACE)]
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {i: rank[s] for i, s in score.items()}

        def symbol(s: str) -> int | None:
            return normal.get(s, self.size + ord(s) if len(s) == 1 else None)

        rows, first_only = [], np.zeros(self.size, bool)
        for s, i in normal.items():
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                if a is not None and b is not None:
                    rows.append((a << 32 | b, rank[i], i))
                    for part in (a, b):
                        if part < self.size and rank[part] >= rank[i]:
                            first_only[part] = True
        owners: dict[int, int] = {}
        for i, r in rank.items():
            if owners.setdefault(r, i) != i:  # two pieces of one score: the leftmost goes first, whichever it is
                first_only[i] = first_only[owners[r]] = True
        rows.sort()
        self.pair, self.pair_rank, self.pair_symbol = (np.array([r[k] for r in rows] or [0], np.int64) for k in range(3))
        self.first_only = first_only

    def _splitting(self, normal: dict[str, int]) -> None:
        """Where no merge crosses: between characters that stand side by side in no piece."""
        pairs = {a + b for s in normal for a, b in zip(s, s[1:])}
        self.side_by_side = np.array(sorted(ord(p[0]) << 32 | ord(p[1]) for p in pairs) or [0], np.int64)
        inner = {c for p in pairs for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inner and c != " ")
        if any(p[1] == SPACE and p[0] != SPACE for p in pairs):
            self.word = re.compile(r".+", re.DOTALL)
        else:  # a run of spaces with what follows, or a character that is part of no longer piece
            self.word = re.compile(rf" *[^ {alone}]+|[{alone}]| +") if alone else re.compile(r" *[^ ]+| +")

    def _forget(self) -> None:
        self.words.clear()
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.used = 0

    # ------------------------------------------------------------------ encoding

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of the unions of neighbours."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        hit = self.pair[at] == key
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_symbol[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words, one after the other; number of them in each word)."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points[points == ord(" ")] = ord(SPACE)
        n = len(points)
        count = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), count)
        key = points[:-1] << 32 | points[1:]
        at = np.searchsorted(self.side_by_side, key)
        at[at == len(self.side_by_side)] = 0
        border = np.ones(n, bool)
        border[1:] = (self.side_by_side[at] != key) | (word[1:] != word[:-1])
        segment = np.cumsum(border) - 1
        symbol, place = self.of_char[points], np.arange(n)  # place: of the symbol's first character, for the order in the end
        done_symbol, done_place = [], []
        rank, union = np.full(n, _NONE), np.zeros(n, np.int64)  # of a symbol and the one behind it
        fresh = np.arange(n)  # symbols whose pair has changed
        for _ in range(self.MOST_ROUNDS):
            if not n:
                break
            look = fresh[fresh < n - 1]
            look = look[segment[look] == segment[look + 1]]
            rank[fresh] = _NONE
            rank[look], union[look] = self._lookup(symbol[look], symbol[look + 1])
            start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, n))
            if (least == _NONE).any():
                stays = np.repeat(least != _NONE, size)
                done_symbol.append(symbol[~stays])
                done_place.append(place[~stays])
                symbol, place, segment, rank, union = symbol[stays], place[stays], segment[stays], rank[stays], union[stays]
                n, size, least = len(symbol), size[least != _NONE], least[least != _NONE]
                if not n:
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # Runs of hits overlap: from the left, every second one. Of some pieces, those that share a score
            # among them, just the first of a segment.
            new_run = np.concatenate([[True], (np.diff(hit) > 1) | (segment[hit[1:]] != segment[hit[:-1]])])
            run_at = np.flatnonzero(new_run)
            behind = np.arange(len(hit)) - np.repeat(run_at, np.diff(np.append(run_at, len(hit))))
            first = np.concatenate([[True], segment[hit[1:]] != segment[hit[:-1]]])
            hit = hit[np.where(self.first_only[union[hit]], first, behind % 2 == 0)]
            symbol[hit] = union[hit]
            stays = np.ones(n, bool)
            stays[hit + 1] = False
            moved = np.cumsum(stays) - 1
            symbol, place, segment, rank, union = symbol[stays], place[stays], segment[stays], rank[stays], union[stays]
            n, hit = len(symbol), moved[hit]
            changed = np.zeros(n, bool)
            changed[hit] = changed[hit[hit > 0] - 1] = True
            fresh = np.flatnonzero(changed)
        if n:
            stays = self._one_by_one(symbol, segment)
            done_symbol.append(symbol[stays])
            done_place.append(place[stays])
        order = np.argsort(np.concatenate([np.zeros(0, np.int64), *done_place]), kind="stable")
        symbol = np.concatenate([np.zeros(0, np.int32), *done_symbol])[order]
        owner = word[np.concatenate([np.zeros(0, np.int64), *done_place])[order]]
        return self._bytes_of_unknown(symbol, owner, len(words))

    def _one_by_one(self, symbol: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Merge pair after pair, the least rank first and the leftmost of a rank; the symbols that stay.

        For the few segments that are not done after all rounds, such as long runs of one character.
        """
        n = len(symbol)
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), np.zeros(n, bool)
        last = np.append(segment[1:] != segment[:-1], True)
        for i in np.flatnonzero(last).tolist():
            after[i] = n
            if i + 1 < n:
                before[i + 1] = -1
        now, known = symbol.tolist(), {}

        def pair(i: int) -> tuple[int, int]:
            key = (now[i], now[after[i]])
            if key not in known:
                r, s = self._lookup(np.array(key[:1]), np.array(key[1:]))
                known[key] = int(r[0]), int(s[0])
            return known[key]

        queue = [(pair(i)[0], i, now[i], now[after[i]]) for i in range(n) if after[i] < n]
        queue = [q for q in queue if q[0] < _NONE]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if dead[i] or j == n or (now[i], now[j]) != (a, b):
                continue
            now[i], dead[j], after[i] = known[a, b][1], True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and pair(k)[0] < _NONE:
                    heapq.heappush(queue, (pair(k)[0], k, now[k], now[after[k]]))
        symbol[:] = now
        return ~dead

    def _bytes_of_unknown(self, symbol: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their UTF-8 bytes."""
        unknown = np.flatnonzero(symbol >= self.size)
        if len(unknown):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (symbol[unknown] - self.size).tolist()]
            each = np.ones(len(symbol), np.int64)
            each[unknown] = [len(r) for r in raw]
            is_raw = np.repeat(symbol >= self.size, each)
            symbol, owner = np.repeat(symbol, each), np.repeat(owner, each)
            symbol[is_raw] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return symbol.astype(np.int32), np.bincount(owner, minlength=words)

    def _store(self, words: list[str]) -> None:
        flat, count = self.merge(words)
        first = len(self.words)
        while len(self.at) < first + len(words):
            self.at, self.length = np.concatenate([self.at, self.at]), np.concatenate([self.length, self.length])
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[first : first + len(words)] = self.used + np.cumsum(count) - count
        self.length[first : first + len(words)] = count
        self.words.update(zip(words, range(first, first + len(words))))
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text)."""
        split = [self.word.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.words) > self.MOST_WORDS:
            self._forget()
        unseen = list(set(chain.from_iterable(split)).difference(self.words))
        if unseen:
            self._store(unseen)
        total = [len(ws) for ws in split]
        index = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, sum(total))
        length = self.length[index]
        ends = np.cumsum(length)
        flat = self.ids[np.repeat(self.at[index] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(total, dtype=np.int64)])]
        if any(len(w) > self.LONGEST for w in unseen):
            self._forget()  # long ones are seldom seen again
        return flat, np.diff(bounds)

    # ------------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library gives it: without one leading space, bytes that are no UTF-8 as U+FFFD."""
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        length = self.surface_len[ids]
        ends = np.cumsum(length)
        flat = self.surface[np.repeat(self.surface_at[ids] - (ends - length), length) + np.arange(ends[-1])]
        spoken = np.flatnonzero(~self.is_silent[ids])
        skip = len(spoken) > 0 and bool(self.is_space_first[ids[spoken[0]]])
        if len(spoken) == len(ids):
            try:
                return flat.tobytes().decode()[skip:]
            except UnicodeDecodeError:
                pass
        return self._decode_parts(ids, skip)

    def _decode_parts(self, ids: np.ndarray, skip: bool) -> str:
        """Runs of byte pieces are read by themselves; what is no character gives one U+FFFD a byte."""
        cuts = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
        out = []
        for run in np.split(ids, cuts):
            raw = b"".join(self.surface[self.surface_at[i] : self.surface_at[i] + self.surface_len[i]].tobytes() for i in run.tolist())
            out.append(raw.decode("utf-8", "each_byte") if self.is_byte[run[0]] else raw.decode())
        return "".join(out)[skip:]


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


_models: dict[str, PieceModel] = {}


def piece_model(path: str | None = None) -> PieceModel:
    """Of the file at ``path``; without one, of the public 32k vocabulary."""
    import codecs

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _models:
        codecs.register_error("each_byte", _each_byte)
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """One row per row: ``id, ids`` (array of int), and with ``decoded`` the text that the ids decode to.

    Ids are those of the library without begin and end ids. A null text is empty and has no ids; a
    text of any length is taken whole, and its longest word bounds the number of rounds. Repeated rows
    give repeated rows; other columns are not read. An empty table gives an empty result. ``path``
    must be readable on every executor.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in slices(batches, 1_000_000):
            flat, count = model.encode([t or "" for t in b.column(1).to_pylist()])
            ends = np.concatenate([[0], np.cumsum(count)])
            cols, names = [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["id", "ids"]
            if decoded:
                cols, names = [*cols, pa.array([model.decode(flat[s:e]) for s, e in zip(ends[:-1], ends[1:])], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, ids array<int>" + (", decoded string" if decoded else "")).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per row: ``id, decoded``. Null ids are none and decode to the empty text; an id beyond the vocabulary is an error."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in batches:
            texts = [model.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    picked = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def op11_piece_encoding(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids_text(F.col("ids")), "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
