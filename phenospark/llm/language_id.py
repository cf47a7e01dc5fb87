"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. One binary linear classifier a bit, logistic loss over
hashed byte n-grams, says how the text leans. The decoder adds up, for each codeword, the
classifiers' losses against its bits, each weighted by how well that bit did in training, and
chooses the codeword with the least. A small lead over the second best marks the text ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import crc_mod, slices

DIMS = 4096
#: Bounds of the training sample: documents a language, and in all.
PER_LANGUAGE = 1000
MOST_DOCUMENTS = 8000
AMBIGUOUS_LEAD = 0.2
_ASCII_LETTER = re.compile(rb"[A-Za-z]")

# Letters are lower-cased (A-Z), bytes of multi-byte characters stay, all else is a space.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(raw: bytes) -> np.ndarray:
    """Counts of hashed byte 1- to 4-grams of the whole text, as unit vector of their logarithms."""
    x = np.empty(len(raw) + 2, np.uint32)
    x[0] = x[-1] = 32
    x[1:-1] = _FOLD[np.frombuffer(raw, np.uint8)]
    if len(x) > 2:  # runs of spaces count once
        x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    four = three[:-1] << 8 | x[3:]
    count = np.bincount(x, minlength=256).astype(np.float64)
    total = np.zeros(DIMS)
    total[:256] = count[:256]
    for grams, mul in ((two, 2654435761), (three, 2246822519), (four, 3266489917)):
        slot = (grams * np.uint32(mul)) >> np.uint32(20)
        total += np.bincount(slot, minlength=DIMS)
    total[32] = 0
    v = np.log1p(total)
    n = np.sqrt(v @ v)
    return (v / n if n else v).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all splits up to 6 languages, else the best of random codes."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        bits = [[1 if i == 0 else 1 - 2 * (b >> (i - 1) & 1) for i in range(n)] for b in range(1, 1 << (n - 1))]
        return np.array(bits, np.int8).T
    rng, best, most = np.random.default_rng(seed), None, -1
    width = max(15, int(np.ceil(10 * np.log2(n))))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        near = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if near > most and (abs(code.sum(0)) < n).all():
            best, most = code, near
    return best


class EcocModel:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], rounds: int = 150, ridge: float = 1e-5) -> EcocModel:
        names = sorted(set(langs))
        code = codewords(len(names))
        y = code[[names.index(v) for v in langs]].astype(np.float32)  # (rows, bits)
        share = np.array([langs.count(v) for v in names], np.float32)
        importance = (1 / share)[[names.index(v) for v in langs]][:, None]
        importance /= importance.sum() if len(langs) else 1
        w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
        look, prev, step = w.copy(), w, 4.0
        for t in range(rounds if code.shape[1] else 0):  # Nesterov; rows have norm 1, so the step is safe
            margin = y * (x @ look[:-1] + look[-1])
            g = -y * importance / (1 + np.exp(np.clip(margin, -30, 30)))
            grad = np.vstack([x.T @ g, g.sum(0)[None]]) + ridge * look
            new = look - step * grad
            look = new + t / (t + 3) * (new - prev)
            prev = new
        w = prev
        right = ((y * (x @ w[:-1] + w[-1]) > 0) * importance).sum(0) if code.shape[1] else np.ones(0)
        return cls(names, code, w, np.clip(2 * right - 1, 0.01, None))

    def decide(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, lead) of each row; score and lead are 0 to 1."""
        f = x @ self.weights[:-1] + self.weights[-1]  # (rows, bits)
        loss = np.stack([(np.logaddexp(0, -f * c) * self.trust).sum(1) for c in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        lead = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
        return [self.languages[i] for i in best], top[:, -1], lead


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text.encode("utf-8", "surrogatepass"))) or any(c.isalpha() for c in text))


def fit_language_model(train: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST_DOCUMENTS) -> EcocModel:
    """Fit on at most about ``per_language`` documents of each language and ``most`` in all.

    The sample is drawn by a hash of the text, so it is spread over all documents and doesn't depend
    on how they are stored; equal texts are drawn once. Only feature vectors reach the driver: ``most``
    times 8 kB, or one a language where there are more languages than ``most``. Null texts or languages
    teach nothing.
    """
    usable = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return EcocModel([], codewords(0), np.zeros((DIMS + 1, 0), np.float32), np.ones(0))
    # The rows with the smallest hashes of each language, whatever the order of the input is. The draw
    # is cut near the number wanted before anything is ranked; equal texts have one hash and rank by nothing else.
    each = min(per_language, max(1, most // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (each + 4 * each**0.5 + 8) / n))])
    draw = F.xxhash64("text", F.lit("draw"))
    near = usable.withColumn("draw", draw).filter((F.pmod("draw", F.lit(1_000_000)) / 1_000_000 < share[F.col("lang")]) | (share[F.col("lang")] >= 1))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1_000_000)), "draw"))
    best = near.select("lang", "draw").distinct().withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", "draw")
    picked = near.join(F.broadcast(best), ["lang", "draw"], "left_semi").dropDuplicates(["lang", "draw"]).select("text", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(features(t.encode("utf-8", "surrogatepass")).astype(np.float16).tobytes(), v) for t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["v", "lang"])

    got = picked.mapInArrow(vectors, "v binary, lang string").collect()
    x = np.stack([np.frombuffer(r.v, np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, DIMS), np.float32)
    return EcocModel.fit(x, [r.lang for r in got])


def identify(docs: DataFrame, model: EcocModel, id_col: str = "doc_id", text_col: str = "text", ambiguous_lead: float = AMBIGUOUS_LEAD) -> DataFrame:
    """``id, lang_pred, score, ambiguous`` for each row, from its whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing has been learned.
    Repeated rows give repeated results; other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            good = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
            lang, score, doubt = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for at in range(0, len(good), 256):
                part = good[at : at + 256]
                names, p, lead = model.decide(np.stack([features(texts[i].encode("utf-8", "surrogatepass")) for i in part]))
                for i, n, s, d in zip(part, names, p, lead):
                    lang[i], score[i], doubt[i] = n, float(s), bool(d < ambiguous_lead)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(doubt)], names=["id", "lang_pred", "score", "ambiguous"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(picked.dtypes)["id"]
    return picked.mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs.filter(crc_mod("doc_id", 4) != 2))
    found = identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
