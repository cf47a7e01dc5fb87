"""Token counts under a unigram segmentation, by dynamic programming over a trie.

A pre-token's best segmentation is the best split of it into vocabulary pieces. The forward score
of a prefix depends on the prefix alone, so in a trie of distinct pre-tokens it is computed once at
the node of that prefix, whatever number of pre-tokens go through it. A terminal's count is stored.

Pieces are those of a public vocabulary file. It has ranks but no probabilities; a piece of rank r
gets the probability of Zipf's law, 1 / ((r + 1) H). ``scores`` takes any other table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

SPACE = "▁"
#: Bounds of what a worker remembers; beyond them it starts anew, which costs time only.
MOST_NODES, MOST_COUNTS, LONGEST_IN_TRIE = 200_000, 400_000, 64


def zipf_scores(vocabulary: str | None = None) -> dict[str, float]:
    """Piece -> log-probability, from a sentencepiece model file (default: the public 32k one)."""
    import sentencepiece

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}


class TrieCounter:
    """Counts the tokens of pre-tokens.

    The best segmentation has the highest sum of scores and, among equal ones, the fewest tokens.
    A character that is no piece falls back to its UTF-8 bytes: that many tokens, each with a
    score below all pieces'.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0
        #: Every ending of a piece: the score of those that are pieces, None of the others.
        self.endings: dict[str, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))} | scores
        self.done: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # of the prefix at a node: score, minus tokens

    def _forward(self, word: str, i: int, before: list[tuple[float, int]]) -> tuple[float, int]:
        """Best of word[:i], given those of all shorter prefixes."""
        ch = word[i - 1]
        if ch in self.scores:
            top = (-math.inf, 0)
        else:
            n = len(ch.encode("utf-8", "surrogatepass"))
            s, t = before[i - 1]
            top = (s + n * self.byte, t - n)
        endings = self.endings
        for j in range(i - 1, max(0, i - self.longest) - 1, -1):
            ending = word[j:i]
            if ending not in endings:
                break
            s = endings[ending]
            if s is not None:
                p, t = before[j]
                if (p + s, t - 1) > top:
                    top = (p + s, t - 1)
        return top

    def count(self, word: str) -> int:
        known = self.done.get(word)
        if known is not None:
            return known
        path = [(0.0, 0)]
        if len(word) > LONGEST_IN_TRIE:  # rare: would fill the trie with nodes that nothing shares
            for i in range(1, len(word) + 1):
                path.append(self._forward(word, i, path))
            return -path[-1][1]
        if len(self.best) > MOST_NODES:
            self._reset()
        if len(self.done) > MOST_COUNTS:
            self.done = {}
        node = 0
        for i, ch in enumerate(word, 1):
            nxt = self.child.get((node, ch))
            if nxt is None:
                nxt = self.child[node, ch] = len(self.best)
                self.best.append(self._forward(word, i, path))
            node = nxt
            path.append(self.best[node])
        n = self.done[word] = -path[-1][1]
        return n


_counters: dict[str | None, TrieCounter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, scores: dict[str, float] | None = None) -> DataFrame:
    """``id, n_pretokens, n_tokens`` for each row, from its whole text.

    Pre-tokens are the maximal runs of characters other than ASCII white space, each with a mark
    for the space before it. A null or empty text has none and no tokens. Repeated rows give
    repeated results; other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if scores is not None:
            counter = TrieCounter(scores)
        elif vocabulary in _counters:
            counter = _counters[vocabulary]
        else:
            counter = _counters[vocabulary] = TrieCounter(zipf_scores(vocabulary))
        count = counter.count
        for b in slices(batches):
            texts = [(t or b"").split() for t in b.column(1).to_pylist()]
            distinct = Counter()
            for t in texts:
                distinct.update(t)
            # In order, neighbours share prefixes.
            n_of = {w: count(SPACE + w.decode("utf-8", "surrogatepass")) for w in sorted(distinct)}
            tokens = [sum(map(n_of.__getitem__, t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_pretokens", "n_tokens"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
