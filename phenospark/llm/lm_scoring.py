"""Scores of a log-bilinear language model trained by noise-contrastive estimation in numpy.

Symbols are the most frequent tokens and, for all other tokens, classes by shape. The model
predicts the next symbol from the two before: a vector for the context is a sum of their vectors,
each through a matrix of its place; its products with the symbols' vectors, plus a bias, are the
log-odds. A token that is no symbol of its own has the probability of its class times its share of
the class, smoothed as in the base score. All probabilities of a context add up to one.

Training runs on all training documents, each in one of a few rounds that a hash of its text names.
In a round every task goes through its own from a common start; then the parameters are averaged,
each symbol's rows weighted by the tokens that a task had of it, and the next round starts there. The
normaliser of every context comes from one matrix product, so a token costs three look-ups. How the
input is dealt to tasks changes the model, so scores (not base scores) differ a little by file layout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, materialize, slices, words

#: The end of a text is a token; no word is empty.
END = b""
SYMBOLS, DIMS = 2048, 16
#: Tokens whose counts every task holds; the counts of all others are joined.
HEAD = 150_000
NOISE, BATCH, RATE = 48, 2048, 0.25
#: Shares of the learning rate in the rounds; each training document is in one of them.
ROUNDS = (1.0, 0.5)

# Shape classes: the last byte (letter, digit, mark, other) and whether a byte is beyond ASCII.
_LAST = np.full(256, 29, np.int64)
_LAST[97:123] = np.arange(26)
_LAST[48:58] = 26
_LAST[46], _LAST[44] = 27, 28
_LAST[128:] = 30
CLASSES = 62


def shape(token: bytes) -> int:
    return int(_LAST[token[-1]]) * 2 + (not token.isascii()) if token else 0


class Symbols(dict):
    """Token -> symbol; classes come first, then the tokens with a symbol of their own."""

    def __init__(self, own: list[bytes]):
        super().__init__((t, CLASSES + i) for i, t in enumerate(own))
        self.own = own
        self.size = CLASSES + len(own)

    def __missing__(self, token: bytes) -> int:
        return shape(token)

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


class LogBilinear:
    def __init__(self, prior: np.ndarray, dims: int = DIMS, seed: int = 11):
        """``prior``: probabilities of the symbols; also the noise. Row ``len(prior)`` of the context
        vectors stands for what is before a text."""
        rng, n = np.random.default_rng(seed), len(prior)
        self.prior = prior.astype(np.float32)
        self.r = rng.normal(0, 0.1, (n + 1, dims)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (n, dims)).astype(np.float32)
        self.c = np.stack([np.eye(dims), np.eye(dims)]).astype(np.float32)
        self.b = np.log(self.prior)
        self.squares = [np.full_like(x, 0.1) for x in (self.r, self.q, self.c, self.b)]
        self.rng = np.random.default_rng(seed + 1)
        self.met = np.zeros((2, n + 1))  # tokens of each symbol, as context and as target

    def step(self, a: np.ndarray, b: np.ndarray, t: np.ndarray, noise: int = NOISE, rate: float = RATE) -> None:
        """One AdaGrad step for targets ``t`` after ``a``, ``b``; all share the noise samples."""
        m, d = self.q.shape
        k = self.rng.choice(m, noise, p=self._noise())
        ra, rb, qt, qk = self.r[a], self.r[b], self.q[t], self.q[k]
        h = ra @ self.c[0] + rb @ self.c[1]
        shift = np.log(noise * self.prior)
        st = (h * qt).sum(1) + self.b[t] - shift[t]
        sk = h @ qk.T + self.b[k] - shift[k]
        gt = -1 / (1 + np.exp(np.clip(st, -30, 30)))
        gk = 1 / (1 + np.exp(-np.clip(sk, -30, 30)))
        gh = gt[:, None] * qt + gk @ qk
        scale = np.float32(1 / len(t))
        self.met[0] += np.bincount(a, minlength=m + 1) + np.bincount(b, minlength=m + 1)
        self.met[1] += np.bincount(t, minlength=m + 1)

        def rows(index: np.ndarray, grad: np.ndarray, n: int) -> np.ndarray:
            at = (index[:, None] * d + np.arange(d)).ravel()
            return np.bincount(at, grad.ravel(), n * d).reshape(n, d).astype(np.float32)

        gq = rows(t, gt[:, None] * h, m)
        np.add.at(gq, k, gk.T @ h)
        gr = rows(np.concatenate([a, b]), np.concatenate([gh @ self.c[0].T, gh @ self.c[1].T]), m + 1)
        gb = np.bincount(t, gt, m) + np.bincount(k, gk.sum(0), m)
        gc = np.stack([ra.T @ gh, rb.T @ gh])
        for x, g, s in zip((self.r, self.q, self.c, self.b), (gr, gq, gc, gb.astype(np.float32)), self.squares):
            g = g * scale
            s += g * g * np.float32(len(t) / 64)
            x -= np.float32(rate) * g * np.float32(len(t) ** 0.5 / 8) / np.sqrt(s)

    def _noise(self) -> np.ndarray:
        p = self.prior.astype(np.float64)
        return p / p.sum()

    def to_rows(self) -> np.ndarray:
        """One row per symbol (context vector, vector, bias), then the rows of the matrices."""
        d = self.r.shape[1]
        own = np.concatenate([self.r, np.vstack([self.q, np.zeros((1, d))]), np.append(self.b, 0)[:, None]], 1)
        mats = np.concatenate([self.c.reshape(-1, d), np.zeros((2 * d, d + 1))], 1)
        return np.vstack([own, mats])

    def weights(self) -> np.ndarray:
        """Of each row of to_rows(): for the context vector, and for the vector and bias. A symbol that
        was never met has a tiny weight, the same in all tasks."""
        every = self.met[1].sum()
        return np.concatenate([self.met + 1e-6, np.full((2, 2 * self.r.shape[1]), every + 1e-6)], 1).T

    def from_rows(self, x: np.ndarray) -> None:
        n, d = self.r.shape
        x = x.astype(np.float32)
        self.r, self.q, self.b = x[:n, :d], x[: n - 1, d : 2 * d], x[: n - 1, 2 * d]
        self.c = x[n:, :d].reshape(2, d, d)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, norm): log p(w | a, b) = first[a, w] + second[b, w] - norm[a, b]."""
        first = self.r @ self.c[0] @ self.q.T + self.b
        second = self.r @ self.c[1] @ self.q.T
        hi, hj = first.max(1, keepdims=True), second.max(1, keepdims=True)
        norm = np.log(np.exp(first - hi) @ np.exp(second - hj).T) + hi + hj.T
        return first.astype(np.float32), second.astype(np.float32), norm.astype(np.float32)


def _contexts(s: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    b = np.concatenate(([before], s[:-1]))
    return np.concatenate(([before], b[:-1])), b


def count_tokens(train: DataFrame) -> DataFrame:
    """``token, c`` of all tokens of the whole texts in column ``text``; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        for b in slices(batches):
            for t in b.column("text").to_pylist():
                seen.update(words(t or b""))
                seen[END] += 1
                if len(seen) > 400_000:
                    yield flush()
                    seen.clear()
        yield flush()

    return train.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _train(train: DataFrame, model: LogBilinear, index: Broadcast, rounds: tuple[float, ...]) -> None:
    """Rounds over ``train``, whose texts are in column ``text``; ``model`` gets the result."""
    width = 2 * DIMS + 1
    which = F.pmod(F.xxhash64("text"), F.lit(len(rounds)))
    for k, slower in enumerate(rounds):
        start = train.sparkSession.sparkContext.broadcast((model.prior, model.to_rows()))

        def fit(batches: Iterator[pa.RecordBatch], slower=slower, start=start) -> Iterator[pa.RecordBatch]:
            prior, rows = start.value
            learner, held, size = LogBilinear(prior), [], 0
            learner.from_rows(rows.copy())
            rng = np.random.default_rng(5)

            def learn() -> None:
                a, b, t = (np.concatenate(x) for x in zip(*held))
                order = rng.permutation(len(t))
                for i in range(0, len(t), BATCH):
                    at = order[i : i + BATCH]
                    learner.step(a[at], b[at], t[at], rate=RATE * slower)

            for batch in slices(batches):
                for raw in batch.column("text").to_pylist():
                    s = index.value.of([*words(raw or b""), END])
                    held.append((*_contexts(s, index.value.size), s))
                    size += len(s)
                    if size > 400_000:
                        learn()
                        held, size = [], 0
            if held:
                learn()
            if learner.met.any():
                rows, w = learner.to_rows(), learner.weights()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(list(rows), pa.list_(pa.float64()))], names=["row", "wr", "wq", "v"])

        trained = train.filter(which == k).select("text").mapInArrow(fit, "row int, wr double, wq double, v array<double>")
        mean = [F.sum(F.col(w) * F.col("v")[i]) / F.sum(w) for i in range(width) for w in ["wr" if i < DIMS else "wq"]]
        got = trained.groupBy("row").agg(F.array(*mean).alias("v")).collect()  # one row a symbol
        if got:
            model.from_rows(np.array([r.v for r in sorted(got, key=lambda r: r.row)]))
        start.unpersist()


def score_texts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS, head: int = HEAD, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``.

    A null text counts as empty; it has one token, its end. Repeated rows count and are scored each;
    very long texts are scored whole. Other columns are not read. With nothing to learn from, all tokens are unknown.
    """
    text = lambda df: df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    docs, train = text(docs), text(train)
    counts = materialize(count_tokens(train), "token-counts")
    total, kinds = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    log_all = np.log10(total + 0.5 * (kinds + 1))

    # The least count of a head token, from a histogram over steps of an eighth of an octave.
    step = F.floor(F.log2("c") * 8).cast("int")
    least, room = 1 << 62, head
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        if r["count"] > room:
            break
        room -= r["count"]
        least = int(np.ceil(2 ** (r.step / 8) - 1e-9))
    known = {r.token if isinstance(r.token, bytes) else bytes(r.token): r.c for r in counts.filter(F.col("c") >= least).collect()}  # ``head`` rows at most
    own = sorted(known, key=lambda t: (-known[t], t))[: symbols - CLASSES]
    index = Symbols(own)

    # Tokens and kinds of tokens in each class.
    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            s = index.of(b.column("token").to_pylist())
            tail = s < CLASSES
            n += np.bincount(s[tail], b.column("c").to_numpy(zero_copy_only=False)[tail], CLASSES).astype(np.int64)
            v += np.bincount(s[tail], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.mapInArrow(classes, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n_class[r.k], v_class[r.k] = r.n, r.v
    log_class = np.log10(n_class + 0.5 * (v_class + 1))
    mass = np.concatenate([n_class, [known[t] for t in own]]) + 0.5
    model = LogBilinear(mass / mass.sum())

    share = docs.sparkSession.sparkContext.broadcast
    _train(train, model, share(index), rounds)
    scorer = share((index, {t: float(np.log10(c + 0.5)) for t, c in known.items()}, model.tables()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, log_of, (first, second, norm) = scorer.value
        to10 = np.log10(np.e)
        pair = pa.struct([("token", pa.binary()), ("tf", pa.int64())])
        for batch in slices(batches):
            n, n_head, base, lm, tails = [], [], [], [], []
            for raw in batch.column("text").to_pylist():
                tokens = [*words(raw or b""), END]
                s = index.of(tokens)
                a, b = _contexts(s, index.size)
                p = (first[a, s].astype(np.float64) + second[b, s] - norm[a, b]).sum() * to10
                in_class = np.bincount(s[s < CLASSES], minlength=CLASSES)
                tail, logs, shared, heads = Counter(), 0.0, 0.0, 0
                for t, k in zip(tokens, s.tolist()):
                    x = log_of.get(t)
                    if x is None:
                        tail[t] += 1
                    else:
                        heads += 1
                        logs += x
                        if k < CLASSES:
                            shared += x
                n.append(len(tokens))
                n_head.append(heads)
                base.append(logs)
                lm.append(float(p + shared - in_class @ log_class))
                tails.append([{"token": t, "tf": c} for t, c in tail.items()])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(n_head, pa.int64()), pa.array(base), pa.array(lm), pa.array(tails, pa.list_(pair))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "n_head", "base", "lm", "tail"])

    scored = docs.mapInArrow(score, f"id {dict(docs.dtypes)['id']}, n long, n_head long, base double, lm double, tail array<struct<token:binary,tf:long>>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("tail").alias("x")).select("row", "x.token", "x.tf")
    rare = rare.join(counts.filter(F.col("c") < least), "token", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_rare")
    )
    out = scored.drop("tail").join(rare, "row", "left").withColumns({"rare": F.coalesce("rare", F.lit(0.0)), "n_rare": F.coalesce("n_rare", F.lit(0))})
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("n_head") + F.col("n_rare")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare") - F.col("n") * F.lit(float(log_all))).alias("base_score"),
        (F.col("lm") + F.col("rare")).alias("score"),
    )


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_texts(docs, docs.filter(crc_mod("doc_id", 5) != 1))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
