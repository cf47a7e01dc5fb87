from __future__ import annotations

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from phenospark.llm import packing, token_counts


def placed(histogram, plan):
    bins = {}
    for length, n in histogram.items():
        s, o = plan.place(np.full(n, length, np.int64), np.arange(n, dtype=np.int64))
        for a, b in zip(s.tolist(), o.tolist()):
            bins.setdefault(a, []).append((b, length))
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(None, None), (3, None), (None, 600), (4, 900)])
def test_best_fit_keeps_every_constraint(rule, limits):
    rng = random.Random(5)
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, 24), 15)}
    cap = packing.Capacity(tokens=40, documents=limits[0], attention=limits[1], rule=rule)
    plan = packing.best_fit(histogram, cap)
    bins = placed(histogram, plan)
    assert sum(map(len, bins.values())) == sum(histogram.values()) and len(bins) == plan.sequences
    for content in bins.values():
        content.sort()
        end = 0
        for offset, length in content:
            assert offset == end
            end += length
        assert end <= 40
        assert limits[0] is None or len(content) <= limits[0]
        assert limits[1] is None or sum(n * n for _, n in content) <= limits[1]


def test_best_fit_is_near_the_lower_bound():
    rng = random.Random(1)
    histogram = {}
    for _ in range(20_000):
        n = min(2048, int(rng.expovariate(1 / 300)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing.best_fit(histogram, packing.Capacity())
    bound = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert bound <= plan.sequences <= bound + 2


def one_by_one(histogram, cap):
    """The rule as it is stated, a piece at a time: sorted contents of the bins."""
    full = (cap.tokens, cap.documents or cap.tokens // min(histogram), cap.attention or cap.tokens**2)
    w = [x / f**2 for x, f in zip(cap.weights, full)]
    bins = []
    for n in sorted(histogram, reverse=True):
        need = (n, 1, n * n)
        for _ in range(histogram[n]):
            best = None
            for i, (left, _) in enumerate(bins):
                if all(r >= x for r, x in zip(left, need)):
                    v = sum(a * (r - x) ** 2 for a, r, x in zip(w, left, need)) if cap.rule == "norm" else -sum(a * r * x for a, r, x in zip(w, left, need))
                    if best is None or (round(v, 12), left) < best[:2]:
                        best = (round(v, 12), left, i)
            if best is None:
                bins.append((full, []))
                best = (0, full, len(bins) - 1)
            left, content = bins[best[2]]
            bins[best[2]] = (tuple(r - x for r, x in zip(left, need)), [*content, n])
    return sorted(sorted(c) for _, c in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(None, None), (3, None), (None, 600), (4, 900), (64, 64**2)])
@pytest.mark.parametrize("seed", range(4))
def test_best_fit_matches_one_by_one(rule, limits, seed):
    """Placing all pieces of a length at once is the same as placing them one at a time."""
    rng = random.Random(seed)
    histogram = {n: rng.randint(1, 9) for n in rng.sample(range(2, 25), 14)}
    cap = packing.Capacity(tokens=64, documents=limits[0], attention=limits[1], rule=rule, steps=None, weights=(1.0, 0.37, 0.21))
    got = placed(histogram, packing.best_fit(histogram, cap))
    assert sorted(sorted(n for _, n in c) for c in got.values()) == one_by_one(histogram, cap)


def test_places_and_cost_weigh_in_where_only_tokens_can_run_out():
    """Two bins with 10 tokens left, of one long piece and of many short ones: the vector tells them apart."""
    rng = random.Random(8)
    histogram = {n: rng.randint(1, 60) for n in rng.sample(range(1, 2049), 400)}
    contents = {}
    for weights in [(1.0, 0.1, 0.1), (1.0, 0.0, 0.0)]:
        cap = packing.Capacity(documents=2048, attention=2048**2, weights=weights)
        bins = placed(histogram, packing.best_fit(histogram, cap))
        contents[weights] = sorted(sorted(n for _, n in c) for c in bins.values())
    a, b = contents.values()
    assert a != b and len(a) <= len(b) + 2


def test_rounding_closes_no_bin_that_tokens_leave_open():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {n: rng.randint(1, 200) for n in rng.sample(range(1, 257), 60)}
        coarse = packing.best_fit(histogram, packing.Capacity(tokens=256, documents=256, attention=256**2, steps=4))
        exact = packing.best_fit(histogram, packing.Capacity(tokens=256, documents=256, attention=256**2, steps=None))
        bound = -(-sum(n * c for n, c in histogram.items()) // 256)
        assert coarse.sequences <= exact.sequences + max(2, bound // 100)


def test_empty_and_too_long():
    assert packing.best_fit({}).sequences == 0
    with pytest.raises(ValueError):
        packing.best_fit({3000: 1})


@pytest.fixture(scope="module")
def library():
    """The tokenizer as its file says, nothing set."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=40), st.sampled_from(["<|endoftext|>", "<|endoftext", " <|endoftext|> ", "日本"])), max_size=6))
def test_ids_equal_the_library(library, parts):
    text = "".join(parts)
    assert packing.encoder("byte_bpe_50k").ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("partitions", [3, 17, 200])
def test_no_two_pieces_share_a_place(spark, partitions):
    """Also where one task cuts the pieces of several partitions, as with more of these than the table has files."""
    rng = random.Random(partitions)
    texts = [" ".join(rng.choice(["the", "of", "42"]) for _ in range(rng.choice([3, 3, 3, 40, 700]))) for _ in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    check_places(packing.pack(docs, capacity=packing.Capacity(tokens=512)).collect(), texts, 512)


def test_no_two_pieces_share_a_place_over_many_files(spark, tmp_path):
    texts = [f"words of number {i} " * (1 + i % 7) for i in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(100).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() == 100
        check_places(packing.op1_best_fit_packing(spark, str(tmp_path)).collect(), texts, 2048)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def check_places(got, texts, tokens):
    enc = packing.encoder("byte_bpe_50k")
    want = {(i, k): x for i, t in enumerate(texts) for k, x in enumerate(packing.cut(len(enc.ids(t)) + 1, tokens))}
    assert len(got) == len(want) and {(r.doc_id, r.piece): (r.start, r.length) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in by.values():
        end = 0
        for o, n in sorted(content):
            assert o == end
            end += n
        assert end <= tokens


def test_pack_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "<|endoftext|> x", "word " * 3000, "é日本語 " * 1200] + [" ".join(rng.choice(["the", "of", "Erinst", "42"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "a", 1)], "doc_id long, text string, piece int")
    got = packing.pack(docs, capacity=packing.Capacity(tokens=512)).collect()
    enc = packing.encoder("byte_bpe_50k")
    want = []
    for i, t in [*enumerate(texts), (3, "a")]:
        ids = np.array([*enc.slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 512)):
            want.append((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
        assert sum(n for _, n in packing.cut(len(ids), 512)) == len(ids) and all(n == 512 for _, n in packing.cut(len(ids), 512)[1:])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in by.values():
        end = 0
        for o, n in sorted(content):
            assert o == end
            end += n
        assert end <= 512
    assert packing.pack(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- token counts


def naive(word, scores):
    """The best of all splits, by trying them."""
    byte = min(scores.values()) - 1

    def best(w):
        if not w:
            return (0.0, 0)
        options = []
        for k in range(1, len(w) + 1):
            head, (s, t) = w[:k], best(w[k:])
            if head in scores:
                options.append((s + scores[head], t - 1))
            elif k == 1:
                n = len(head.encode())
                options.append((s + n * byte, t - n))
        return max(options)

    return -best(word)[1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=9), max_size=12), st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=4), st.integers(-9, -1).map(float), min_size=1, max_size=9))
def test_trie_counts_equal_brute_force(words, scores):
    counter = token_counts.TrieCounter(scores)
    for w in words + words:
        assert counter.count(w) == naive(w, scores)


def test_bounds_change_nothing(monkeypatch):
    words = [f"{a}{b}{c}" for a in "abc" for b in "xyz" for c in "pqr"] * 2
    scores = {x: -float(i + 1) for i, x in enumerate(["a", "b", "c", "ax", "by", "xp", "x", "y", "z", "pq", "p", "q", "r"])}
    want = [token_counts.TrieCounter(scores).count(w) for w in words]
    for name in ("MOST_NODES", "MOST_COUNTS", "LONGEST_IN_TRIE"):
        monkeypatch.setattr(token_counts, name, 2)
    small = token_counts.TrieCounter(scores)
    assert [small.count(w) for w in words] == want


def test_count_tokens(spark):
    rows = [(1, None), (2, ""), (3, " the  of\tthe "), (3, "x" * 3000), (None, "日本")]
    docs = spark.createDataFrame([(*r, 7, "w", [1]) for r in rows], "doc_id long, text string, tokens long, words string, id array<int>")
    got = token_counts.count_tokens(docs).collect()
    scores = token_counts.zipf_scores()
    counter = token_counts.TrieCounter(scores)
    want = [(1, 0, 0), (2, 0, 0), (3, 3, 2 * counter.count("▁the") + counter.count("▁of")), (3, 1, counter.count("▁" + "x" * 3000)), (None, 1, counter.count("▁日本"))]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert token_counts.count_tokens(docs.limit(0)).count() == 0 and math.isfinite(min(scores.values()))
