from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from phenospark.llm import language_id as L
from phenospark.llm import lm_scoring as M
from phenospark.llm import quality_classifier as Q
from phenospark.llm import queries

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = [(1, None), (2, ""), (2, "1234 !!"), (None, "the text is here"), (3, "x" * 50_000), (4, "word " * 20_000)]


def mod(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@data
def test_quality_on_held_out_rows(spark):
    got = queries.QUERIES["op5_quality_classifier"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    j = got[got.held_out].merge(labels, on="doc_id")
    assert auc(j.score.to_numpy(), j.quality.to_numpy()) > 0.99 and (j.predicted == j.quality).mean() > 0.97
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: mod(i, 3) == 1)).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in ODD], "doc_id long, text string, length double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    stats = Q.document_statistics(docs)
    model = Q.fit(stats, labels)
    assert all(0 <= r.score <= 1 and math.isfinite(r.score) for r in Q.score_statistics(stats, model).collect())
    none = Q.fit(stats, labels.limit(0))
    assert Q.score_statistics(stats, none).count() == len(ODD) and Q.score_statistics(stats.limit(0), none).count() == 0
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() <= len(ODD)


def test_discriminant_against_direct_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (50, 3)), rng.normal(1, 2, (80, 3))]
    m = Q.QuadraticDiscriminant.from_moments(np.array([50.0, 80.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]))
    t = rng.normal(0, 2, (20, 3))
    dens = []
    for v in x:
        c = np.cov(v.T, bias=True)
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.05 * np.eye(3)
        z = t - v.mean(0)
        dens.append(np.log((len(v) + 1) / 132) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    assert np.allclose(m.score(t), 1 / (1 + np.exp(-(dens[1] - dens[0]) / 3)))


@data
def test_language_on_held_out_rows(spark):
    got = queries.QUERIES["op10_language_id"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98
    assert (got.held_out == got.doc_id.map(lambda i: mod(i, 4) == 2)).all() and got.score.between(0, 1).all()


def test_language_edges(spark):
    train = spark.createDataFrame([(i, t, la, 1) for i, (t, la) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("x", None)] * 5)], "doc_id long, text string, lang string, score int")
    docs = spark.createDataFrame(ODD + [(9, "日本語"), (10, "und die der")], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs, L.fit_language_model(train)).collect()}
    assert {(1, "und"), (2, "und"), (10, "de"), (None, "en")} <= got and (9, "und") not in got
    empty = L.fit_language_model(train.limit(0))
    assert {r.lang_pred for r in L.identify(docs, empty).collect()} == {"und"}
    one = L.fit_language_model(train.filter("lang = 'en'"))
    assert {r.lang_pred for r in L.identify(docs, one).collect()} == {"und", "en"}
    assert L.identify(docs.limit(0), one).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9, 30])
def test_codewords_are_far_apart(n):
    c = L.codewords(n)
    near = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
    assert near >= (1 if n == 2 else 2) and len({tuple(r) for r in c}) == n


# ---------------------------------------------------------------- language model


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    model = M.LogBilinear(np.full(90, 1 / 90), dims=6)
    for _ in range(30):
        a, b, t = (rng.integers(0, 90, 256) for _ in range(3))
        model.step(a, b, t)
    first, second, norm = model.tables()
    total = np.exp(first[:, None, :] + second[None, :, :] - norm[:, :, None]).sum(2)
    assert np.allclose(total, 1, atol=1e-4)
    again = M.LogBilinear(np.full(90, 1 / 90), dims=6)
    again.from_rows(model.to_rows())
    assert np.allclose(again.tables()[2], norm, atol=1e-4)


def test_training_learns():
    rng = np.random.default_rng(2)
    model = M.LogBilinear(np.full(10, 0.1), dims=8)
    for _ in range(400):
        b = rng.integers(0, 10, 512)
        model.step(rng.integers(0, 10, 512), b, (b + 1) % 10)
    first, second, norm = model.tables()
    b = np.arange(10)
    assert np.exp(first[3, (b + 1) % 10] + second[b, (b + 1) % 10] - norm[3, b]).mean() > 0.5


@data
def test_scores_against_brute_force(spark):
    got = queries.QUERIES["op7_lm_scoring"](spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in zip(docs.doc_id, docs.text)}
    c = Counter(x for i, ts in tokens.items() if mod(i, 5) != 1 for x in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got.loc[i]
        assert r.n_tokens == len(ts) and r.n_known == sum(x in c for x in ts) and r.train_tokens == n and r.held_out == (mod(i, 5) == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()


@data
def test_op7_scores_from_the_trained_model(spark, monkeypatch):
    """score of the query, token by token from the model's vectors: softmax over all symbols, then the token's share of its class."""
    kept = {}
    train = M._train

    def keep(rows, model, index, rounds):
        train(rows, model, index, rounds)
        kept.update(model=model, index=index.value)

    monkeypatch.setattr(M, "_train", keep)
    got = {r.doc_id: r.score for r in queries.QUERIES["op7_lm_scoring"](spark, SF).collect()}
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    c = Counter(x for i, ts in docs.items() if mod(i, 5) != 1 for x in ts)
    model, index = kept["model"], kept["index"]
    r, q, mats, bias = (np.asarray(x, np.float64) for x in (model.r, model.q, model.c, model.b))
    total, kinds = Counter(), Counter()
    for t, n in c.items():
        if index[t] < M.CLASSES:
            total[index[t]] += n
            kinds[index[t]] += 1
    some = [i for i in sorted(docs) if len(docs[i]) < 250][:40]
    assert len(some) == 40
    for i in some:
        a = b = len(bias)
        want = 0.0
        for t in docs[i]:
            k = index[t]
            z = (r[a] @ mats[0] + r[b] @ mats[1]) @ q.T + bias
            want += (z[k] - np.logaddexp.reduce(z)) / np.log(10)
            if k < M.CLASSES:
                want += math.log10(c[t] + 0.5) - math.log10(total[k] + 0.5 * (kinds[k] + 1))
            a, b = b, k
        assert math.isclose(got[i], want, rel_tol=2e-4, abs_tol=2e-3), i


def test_a_very_long_text_is_scored_whole(spark):
    rng = np.random.default_rng(5)
    long = " ".join(rng.choice(["the", "of", "and", "x1", "x2"], 200_000))
    docs = spark.createDataFrame([(1, long), (2, "the of"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in M.score_texts(docs, docs).collect()}
    c = Counter(long.split() + ["", "the", "of", "", ""])
    n, v = sum(c.values()), len(c)
    assert got[1].n_tokens == got[1].n_known == 200_001 and got[1].train_tokens == n
    assert math.isclose(got[1].base_score, sum(k * math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t, k in Counter(long.split() + [""]).items()), rel_tol=1e-9)
    assert got[1].score < 0


def test_small_head_changes_nothing(spark):
    docs = spark.createDataFrame([(i, f"the a{i % 7} b{i % 3} " * (i % 5), "x") for i in range(60)] + [(None, None, "x"), (5, "The", "x")], "doc_id long, text string, n string")
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 9)) for r in df.collect())
    assert key(M.score_texts(docs, docs.limit(40), head=3)) == key(M.score_texts(docs, docs.limit(40)))
    nothing = M.score_texts(docs, docs.limit(0)).collect()
    assert all(r.n_known == 0 and abs(r.base_score) < 1e-9 and r.train_tokens == 0 for r in nothing)
    assert M.score_texts(docs.limit(0), docs).count() == 0


def test_statistics_against_counting():
    """Each of the twelve, by going over the characters and words one by one."""
    from phenospark.llm import quality_classifier as Q

    for text in ["", "Hello, World. The the THE cat!!", "É À é ß | # $ 12 34\n\nx x x", "日本 日本 a", " \t\n ", "AAAA|" * 50]:
        raw = text.encode()
        words = raw.split()
        n, k = len(raw), len(words)
        upper = sum(65 <= x <= 90 for x in raw) + sum(a == 0xC3 and 0x80 <= b < 0x9F for a, b in zip(raw, raw[1:]))
        count = {
            "upper": (upper, 0.02, n), "symbols": (sum(chr(x) in "#$%&*^~<>{}[]\\@_=+/`" for x in raw), 0.002, n), "exclamations": (raw.count(b"!"), 0.001, n), "bars": (raw.count(b"|"), 0.001, n),
            "stops": (raw.count(b".") + raw.count(b","), 0.02, n), "digits": (sum(48 <= x <= 57 for x in raw), 0.002, n), "other": (sum(x > 127 for x in raw), 0.05, n),
            "echo": (sum(a == b for a, b in zip(words, words[1:])), 0.01, k), "distinct": (len(set(words)), 0.7, k), "word_length": (n - k, 5.0, k), "lines": (raw.count(b"\n"), 0.003, n),
        }
        want = [math.log(n + 60)] + [math.log((count[f][0] + 60 * count[f][1]) / (count[f][2] + 60)) for f in Q.FEATURES[1:]]
        assert np.allclose(Q.statistics(raw), want, atol=1e-12), text
