"""Encoding and decoding against the sentencepiece library, fill-in-middle against the rule in plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from phenospark.llm import fill_in_middle, piece_encoding

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PARTS = ["a", "b", "the", "\u2581", " ", "  ", "    ", "in", "er", "\u00e9", "\u65e5\u672c", "\n", "\t", "1", "23", "\U0001f600", "\u00f1", "aaaa", "ing", "th", "e", "\x00", "<0x0A>", "<s>", "\u200b", "\ufb01", "."]


def same(model, texts):
    flat, count = model.encode(texts)
    at = 0
    for t, n in zip(texts, count.tolist()):
        ids = flat[at : at + n]
        at += n
        assert ids.tolist() == LIBRARY.encode(t)
        assert model.decode(ids) == LIBRARY.decode(ids.tolist())
    assert at == len(flat)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.text(st.characters(exclude_categories=["Cs"]), max_size=40)), max_size=4))
def test_ids_equal_the_library(texts):
    same(piece_encoding.piece_model(MODEL), texts)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_ids_equal_the_library_with_few_rounds(rounds, monkeypatch):
    """What the rounds leave is merged pair by pair."""
    piece_encoding.piece_model()
    model = piece_encoding.PieceModel(MODEL)
    monkeypatch.setattr(model, "MOST_ROUNDS", rounds)
    rng = random.Random(rounds)
    for _ in range(200):
        same(model, ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(3)])


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 20_001, "abc" * 9_000, "\u65e5" * 9_000, "-=" * 9_000])
def test_very_long_words(text):
    same(piece_encoding.piece_model(), [text, "x " + text + " y"])


def test_forgetting_words_changes_nothing(monkeypatch):
    model = piece_encoding.PieceModel(MODEL)
    monkeypatch.setattr(model, "MOST_WORDS", 3)
    for k in range(30):
        same(model, [f"some words of text {k}", "and some others", ""])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 13, 100, 200, 230, 180, 198, 230 + 3, 132, 259, 260, 29871, 263, 278]), max_size=9))
def test_any_ids_decode_as_in_the_library(ids):
    assert piece_encoding.piece_model().decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_ranks_that_are_not_in_order_of_growth(tmp_path):
    """A vocabulary in which a longer piece often has the better score than its parts; against merging one by one."""
    rng = random.Random(3)
    model = piece_encoding.PieceModel(MODEL)
    for _ in range(60):
        names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(14)} | {"a", "b"})
        normal = {s: 300 + i for i, s in enumerate(names)}
        score = {i: float(rng.randint(-6, -1)) for i in normal.values()}
        model._merging(normal, score)
        model._splitting(normal)
        for _ in range(20):
            word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
            now = list(word)
            while pairs := [(-score[normal[a + b]], k) for k, (a, b) in enumerate(zip(now, now[1:])) if a + b in normal]:
                k = min(pairs)[1]
                now[k : k + 2] = [now[k] + now[k + 1]]
            want = [i for s in now for i in ([normal[s]] if s in normal else [int(model.byte[ord(s)])])]
            assert model.merge([word])[0].tolist() == want, (word, normal, score)


def test_encode_and_decode_tables(spark):
    texts = [None, "", " ", "the  end", "\u2581x", "\x00\n", "word " * 40_000, "\U0001f600 \u00f1"]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(3, "the  end", [2]), (None, "x", None)], "doc_id long, text string, ids array<int>").repartition(3)
    got = piece_encoding.encode(docs, decoded=True)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = [(i, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in [*enumerate(texts), (3, "the  end"), (None, "x")]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    back = piece_encoding.decode(got.drop("decoded").withColumnRenamed("doc_id", "id"), "id").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, t)) for i, _, t in want)
    assert piece_encoding.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded == ""
    assert piece_encoding.encode(docs.limit(0)).count() == 0


def test_op11_query_against_the_library(spark, tmp_path):
    texts = [None, "", "some words\n of it", "\u00e9t\u00e9 " * 300, "x" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in piece_encoding.op11_piece_encoding(spark, str(tmp_path)).collect():
        ids = LIBRARY.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hexed(",".join(map(str, ids))), hexed(LIBRARY.decode(ids)))


def test_another_kind_of_model_is_refused(monkeypatch):
    class Other:
        def __init__(self, model_file):
            self.sp = LIBRARY

        def __getattr__(self, name):
            return getattr(LIBRARY, name)

        def normalize(self, text):
            return text.casefold()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        piece_encoding.PieceModel(MODEL)


# ---------------------------------------------------------------- fill-in-middle


def by_rule(doc_id, text, o):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{o.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]
    if not text or any(m in text for m in (o.prefix, o.suffix, o.middle)) or h[2] % 100 >= o.rate:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < o.suffix_first:
        return (doc_id, n, "spm", len(parts[0]), len(parts[1]), o.suffix + parts[2] + o.prefix + parts[0] + o.middle + parts[1])
    return (doc_id, n, "psm", len(parts[0]), len(parts[1]), o.prefix + parts[0] + o.suffix + parts[2] + o.middle + parts[1])


@pytest.mark.parametrize("options", [fill_in_middle.FillInMiddle(), fill_in_middle.FillInMiddle(seed=3, rate=60, suffix_first=20, prefix="<|p|>", suffix="<|s|>", middle="<|m|>")])
def test_fill_in_middle_against_the_rule(spark, options):
    rng = random.Random(4)
    alphabet = ["a", "\n", "\r\n", "\n\n", "<P>", "<S", ">", "<M>x", "\U0001f600", "\u00e9", " ", "line of code", "<|s|>", "$1", "\\"]
    weights = [9, 9, 3, 2, 0.2, 1, 1, 0.2, 3, 3, 3, 9, 0.2, 1, 1]
    texts = [None, "", "\n", "no end", "x\n" * 20_000, "y" * 300_000] + ["".join(rng.choices(alphabet, weights, k=rng.randint(1, 40))) for _ in range(400)]
    rows = [*enumerate(texts), (3, "no end"), (None, "a\nb\nc")]
    docs = spark.createDataFrame([(i, t, 7, "n") for i, t in rows], "doc_id long, text string, n int, form string").repartition(5)
    got = fill_in_middle.fill_in_middle(docs, options=options)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(by_rule(i, t, options)) for i, t in rows)
    back = got.select("doc_id", fill_in_middle.restored(got.output, got.form, options).alias("text")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((i, t or "")) for i, t in rows)
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_sentinels_must_differ():
    with pytest.raises(ValueError):
        fill_in_middle.FillInMiddle(prefix="<S>")
    with pytest.raises(ValueError):
        fill_in_middle.FillInMiddle(prefix="<<S>>")


def test_fill_in_middle_stays_in_spark(spark):
    plan = fill_in_middle.op12_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
