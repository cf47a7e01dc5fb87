"""Ranked search against the rule in plain Python, and the tree against sorting."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from phenospark.llm import lexical_search
from phenospark.llm.lexical_search import DualSorted, Ranking

_PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return _PATTERN.findall((text or "").translate(_LOWER))


def by_rule(docs, items, r):
    """(item, rank, doc, score) with one entry for each row of ``items``."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n_docs, n_terms = len(bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for i, text in items:
        scored = []
        for d, c in bags:
            m = 100 - r.b + (r.b * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((r.scale * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is not None, d if d is not None else 0))
        out += [(i, k + 1, d if there else None, -s) for k, (s, there, d) in enumerate(sorted(scored)[: r.k])]
    return out


WORDS = ["The", "the", "of", "Über", "naïve", "日本", "a1", "x", "y", "z", "42", "rare", "common", "İ"]


def rows(spark, seed, n):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, range(len(WORDS), 0, -1), k=rng.randint(0, 30))) + rng.choice(["", ".", "-x_y", "\x00z"]) for _ in range(n)]
    texts += [texts[0]] * 40 + [None, "", "!! --", "the " * 30_000, "Rare"]
    docs = [(rng.randint(0, 10**12), t) for t in texts] + [(None, texts[1]), (5, texts[2]), (5, texts[2]), (5, texts[3])]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))) for i in range(12)] + [(3, "rare x x"), (3, "rare x x"), (20, None), (21, ""), (22, "?!"), (23, "unheard of"), (24, "unheard"), (None, "naïve")]
    return docs, items


@pytest.mark.parametrize("seed, partitions, shard, block", [(1, 1, 10**6, 10**6), (2, 7, 150, 10**6), (3, 3, 1, 10**6), (4, 5, 400, 60)])
def test_search_against_the_rule(spark, seed, partitions, shard, block):
    docs, items = rows(spark, seed, 300)
    d = spark.createDataFrame([(i, t, 9, 1, "s") for i, t in docs], "doc_id long, text string, n int, score int, item_id string").repartition(partitions)
    q = spark.createDataFrame([(i, t, 4) for i, t in items], "item_id int, text string, doc_id int")
    ranking = Ranking(k=6)
    got = lexical_search.search(d, q, ranking=ranking, shard_postings=shard, block_chars=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, by_rule(docs, items, ranking)))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    q = spark.createDataFrame([("a", "words")], "item_id string, text string")
    assert lexical_search.search(d.limit(0), q).count() == 0
    assert lexical_search.search(d, q.limit(0)).count() == 0
    assert lexical_search.search(d, spark.createDataFrame([("a", None)], q.schema)).count() == 0
    assert [tuple(r) for r in lexical_search.search(d, q).collect()] == by_rule([(1, "some words")], [("a", "words")], Ranking())
    named = spark.createDataFrame([("1", "some words"), ("b", "others")], "k string, text string")
    assert lexical_search.search(named, q, id_col="k").first().k == "1"


@pytest.mark.parametrize("seed", range(6))
def test_the_tree_gives_the_best_and_their_order(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms = int(rng.integers(1, 200)), 12
    lists = [(t, d, int(rng.integers(1, 6))) for t in range(n_terms) for d in range(n_docs) if rng.random() < rng.random()]
    term, doc, impact = (np.array([x[c] for x in lists], np.int64) for c in range(3))
    tree = DualSorted(term, doc, impact, n_docs)
    for k in (1, 3, 20, 500):
        asked = np.sort(rng.choice(n_terms + 2, 5, replace=False))
        weight = rng.integers(0, 4, 5)
        score = defaultdict(int)
        for t, d, x in lists:
            if t in asked:
                score[d] += x * int(weight[asked.tolist().index(t)])
        ranked = sorted((-s, d) for d, s in score.items() if s > 0)
        places, scores = tree.best(asked, weight, k)
        assert list(zip((-scores).tolist(), places.tolist())) == ranked[:k]
        if ranked:
            s, d = ranked[len(ranked) // 2]
            places, scores = tree.best(asked, weight, k, -s, d)
            assert list(zip((-scores).tolist(), places.tolist())) == [x for x in ranked if x < (s, d)][:k]


def test_the_tree_holds_lists_by_impact_and_nodes_by_document():
    rng = np.random.default_rng(1)
    pairs = sorted({(int(t), int(d)) for t, d in rng.integers(0, 30, (400, 2))})
    term, doc = (np.array([p[c] for p in pairs]) for c in range(2))
    impact = rng.integers(1, 9, len(pairs))
    tree = DualSorted(term, doc, impact, 30)
    for t, s, e in zip(tree.terms.tolist(), tree.start.tolist(), tree.end.tolist()):
        assert sorted(impact[term == t], reverse=True) == tree.impact[0, s:e].tolist()
        stack = [(0, s, e, 0)]
        while stack:
            level, s, e, low = stack.pop()
            inside = (term == t) & (doc >> (tree.levels - level) == low)
            assert sorted(impact[inside], reverse=True) == tree.impact[level, s:e].tolist()
            if level < tree.levels and e > s:
                a, b = int(tree.zeros[level, s]), int(tree.zeros[level, e])
                z = int(tree.zeros[level, -1])
                stack += [(level + 1, a, b, 2 * low), (level + 1, z + s - a, z + e - b, 2 * low + 1)]


def test_best_documents_close_most_nodes(monkeypatch):
    """A planted document is found without opening the whole tree."""
    rng = np.random.default_rng(2)
    n_docs = 4096
    pairs = {(int(t), int(d)) for t, d in zip(rng.integers(0, 200, 60_000), rng.integers(0, n_docs, 60_000))} | {(t, d) for t in range(40) for d in (77, 78, 2000)}
    term, doc = (np.array(x) for x in zip(*sorted(pairs)))
    tree = DualSorted(term, doc, np.full(len(term), 5), n_docs)
    seen = []
    add = lexical_search._Rows.add
    monkeypatch.setattr(lexical_search._Rows, "add", lambda self, more: (seen.append(len(more)), add(self, more))[1])
    places, _ = tree.best(np.arange(40), np.ones(40, np.int64), 3)
    assert places.tolist() == [77, 78, 2000]
    assert sum(seen) < 12 * len(pairs)
