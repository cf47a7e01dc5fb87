from __future__ import annotations

import random
import re

import numpy as np
import pytest

from phenospark.llm import decontamination as D
from phenospark.llm import ngram_join as N


def shingle_set(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
                links += sets[i] != sets[j]
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))], links


def near_copies(rng, n, words=60):
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(8, words))] for _ in range(6)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, words))] + passage
        out.append(rng.choice([" ", "\n", " \t "]).join(x.upper() if rng.random() < 0.1 else x for x in w))
    return out


SPECIAL = [None, "", "  \n", "one", "One", "one two", "a b c", "a b c d", " x y", " x y"]


@pytest.mark.parametrize("seed,k,percent,block", [(1, 4, 85, 256), (2, 5, 80, 7), (3, 2, 70, 3)])
def test_components_against_brute_force(spark, seed, k, percent, block):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(SPECIAL + near_copies(rng, 150))] + [(3, "one"), (500, "a b c d"), (None, "a b c d")]
    docs = spark.createDataFrame([(i, t, "n", "root") for i, t in rows], "doc_id long, text string, node string, root string")
    join = N.Join(shingle=k, percent=percent, block=block, leaf=4, fan=2)
    want, _ = brute_components(rows, k, percent)
    got = [tuple(r) for r in N.ngram_components(docs, join=join).collect()]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("by_bands", [False, True])
def test_scattered_large_group(spark, monkeypatch, by_bands):
    """Texts of one template: routed to one group, most of them not linked, some pairs linked."""
    taken, buckets = [], N._bucket_pairs
    if by_bands:  # as in a group of more blocks than there are bands
        monkeypatch.setattr(N, "_large_groups", lambda *a, **k: taken.append(1) or buckets(*a, **k))
    rng = random.Random(12)
    template = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(120):
        w = template[:60] + [f"v{i % 40}_{k}" for k in range(14)]
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = N.Join(shingle=2, percent=85, block=8)
    want, links = brute_components(rows, 2, 85)
    assert 10 < len({c for _, _, c in want}) < 110 and links
    assert sorted(tuple(r) for r in N.ngram_components(docs, join=join).collect()) == sorted(want)
    assert bool(taken) == by_bands


def test_very_long_and_repetitive_texts(spark):
    long = " ".join(f"w{i % 7919} q{i}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "same " * 300_000), (4, "same " * 5), (5, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), join=N.Join(shingle=4, percent=85)).collect()}
    assert got == {1: (299_997, 1), 2: (299_998, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_session_is_left_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    N.ngram_components(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("bands", [64, 1])
def test_all_links(spark, monkeypatch, bands):
    large = N._large_groups
    monkeypatch.setattr(N, "_large_groups", lambda m, j, e: large(m, j, e) if bands > 1 else N._bucket_pairs(m, j, e))
    rng = random.Random(9)
    texts = list(dict.fromkeys(near_copies(rng, 80)))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = N.Join(shingle=3, percent=75, block=5)
    pairs, members = N.ngram_links(docs, join=join)
    own = {}
    for i, t in rows:
        own.setdefault(frozenset(shingle_set(t, 3)), i)
    reps = [(i, s) for s, i in own.items() if s]
    want = {(min(i, j), max(i, j), len(a & b)) for x, (i, a) in enumerate(reps) for j, b in reps[:x] if 100 * len(a & b) >= 75 * len(a | b)}
    assert {(min(r.a, r.b), max(r.a, r.b), r.overlap) for r in pairs.collect()} == want
    assert {(r.rep, r.id) for r in members.collect()} == {(own[frozenset(shingle_set(t, 3))], i) for i, t in rows}


def test_drop_near_copies(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(SPECIAL + near_copies(rng, 60))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, stays string")
    join = N.Join(shingle=4, percent=80)
    want, _ = brute_components(rows, 4, 80)
    kept = N.drop_near_copies(docs, join=join)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in want if c == d)
    # One id with several near texts: one of them stays.
    same = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (1, "A b c d e f g h i j k l m n o p q r s t u v w x y z"), (None, None)], "doc_id long, text string")
    assert N.drop_near_copies(same, join=join).count() == 2
    assert N.drop_near_copies(docs.limit(0), join=join).count() == 0


def test_tree_never_loses_a_link():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        sets = []
        for _ in range(40):
            keep = base[rng.random(60) < 0.93]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 6)).astype(np.uint64)])))
        join = N.Join(percent=80, leaf=3, fan=2)
        want = {(i, j) for i in range(40) for j in range(i) if join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
        assert {(max(i, j), min(i, j)) for i, j, _ in N.tree_join(sets, join, every=True)} == want


def test_routing_miss_is_bounded():
    for percent in (70, 80, 85, 90, 95):
        j = N.Join(percent=percent)
        assert (1 - (percent / 100) ** j.rows) ** j.bands <= 1e-8


# ---------------------------------------------------------------- decontamination


def brute_tiles(p, q, seed):
    """Greedy string tiling by its definition."""
    used_p, used_q, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(q)):
                n = 0
                while i + n < len(p) and j + n < len(q) and p[i + n] == q[j + n] and i + n not in used_p and j + n not in used_q:
                    n += 1
                if n >= seed and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        tiles.append(best)
        used_p |= set(range(best[0], best[0] + best[2]))
        used_q |= set(range(best[1], best[1] + best[2]))


@pytest.mark.parametrize("seed", range(12))
def test_tiles_against_brute_force(seed):
    """Index and tiling of several items at once, from two words that repeat all the time to seven."""
    rng = random.Random(seed)
    words = "abcdefg"[: 1 + seed % 7]
    items = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(5)]
    q = items[2]
    p = [rng.choice(words) for _ in range(10)] + q[len(q) // 2 :] + [rng.choice(words) for _ in range(5)] + q[:13] + items[0]
    tiling = D.Tiling(seed=3, coverage=0.0, least=0)
    hashes = D.WordHashes()
    index = D.Index([(k, " ".join(w)) for k, w in enumerate(items)], tiling, hashes)
    got = {k: (m, n, sorted(t)) for k, m, n, t in index.found([x.encode() for x in p], hashes)}
    want = {}
    for k, w in enumerate(items):
        tiles = brute_tiles(p, w, 3)
        if tiles:
            want[k] = (len(w), sum(t[2] for t in tiles), sorted(tiles))
    assert got == want


def test_a_million_repeated_words_take_memory_in_proportion():
    tiling, hashes = D.Tiling(), D.WordHashes()
    index = D.Index([(0, "la " * 60), (1, "la la la " * 20 + "end " * 30), (2, "none of these words is there at all " * 3)], tiling, hashes)
    h = hashes.of([b"la"] * 1_000_000)
    places, runs, items = index.candidates(h)
    p, q, n = index.matches(h, D._Sums(h), places, runs, 0)
    assert items.tolist() == [0, 1] and len(p) < 2 * 1_000_200 and n.max() == 60
    assert {k: n for k, _, n, _ in index.found([b"la"] * 1_000_000, hashes)} == {0: 60, 1: 60}


def test_a_run_that_many_items_share_costs_no_pairs():
    """A template of ten words in each of thousands of items, hundreds of times in a document: none is covered
    by it, so no pair of places is made. One item that is there whole is found."""
    import tracemalloc

    template = " ".join(f"t{k}" for k in range(10))
    items = [(k, template + " " + " ".join(f"i{k}w{j}" for j in range(16))) for k in range(4000)]
    tiling, hashes = D.Tiling(), D.WordHashes()
    index = D.Index(items, tiling, hashes)
    text = " x ".join([template] * 400) + " y " + items[77][1]
    words = D.normal_words(text)
    assert index.candidates(hashes.of(words))[2].tolist() == [77]
    tracemalloc.start()
    assert [(k, n) for k, _, n, _ in index.found(words, hashes)] == [(77, 26)]
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_blocks_are_taken_one_after_the_other(spark):
    """No worker holds two indexes: a stage has one Python step, whatever the number of blocks; repeated items repeat rows."""
    rng = random.Random(8)
    items = [(k % 30, " ".join(f"w{rng.randrange(300)}" for _ in range(25))) for k in range(40)]
    items += [items[3]] * 3 + [(99, items[4][1])] * 2
    docs = [(i, " ".join(["lead"] * i) + " " + items[i % 40][1]) for i in range(60)] + [(60, None), (61, "clean")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = D.contamination(d, b), D.contamination(d, b, block_chars=600)
    rows = lambda df: sorted((r.doc_id, r.item_id, r.item_words, r.covered) for r in df.collect())
    assert rows(one) == rows(many) and len(rows(one)) == 60 + 2 * 3 + 2 * 2
    kept = D.drop_contaminated(d, b, block_chars=600)
    assert sorted(r.doc_id for r in kept.collect()) == [60, 61]
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_short_items_are_found_whole():
    tiling, hashes = D.Tiling(), D.WordHashes()
    index = D.Index([(7, "Yes, indeed."), (8, ""), (9, None)], tiling, hashes)
    found = lambda t: [x[:3] for x in index.found(D.normal_words(t), hashes)]
    assert found("yes indeed") == [(7, 2, 2)]
    assert found("yes indeed it is") == found("") == found("yes indeed it is so and so on") == []


def test_op3_against_brute_force(spark, tmp_path):
    """The registered query over a fixture with reordered, cut, repeated and clean passages."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60)))) for i in range(25)] + [(25, "so so so " * 15), (26, None)]
    docs = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.7:
            t = rng.choice(items)[1] or ""
            t = t.split()
            cut = rng.randint(0, len(t))
            w[rng.randint(0, len(w)) : 0] = rng.choice([t, t[cut:] + ["gap"] + t[:cut], t[:cut]])
        docs.append((i, " ".join(w)))
    docs += [(150, None), (151, ""), (3, items[4][1]), (152, "so " * 5000)]
    spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, covered double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tiling, want = D.Tiling(), []
    for d, text in docs:
        if d == 152:
            want.append((152, 25, 45, 45))
            continue
        p = (text or "").lower().split()
        for k, item in items:
            q = (item or "").lower().split()
            tiles = brute_tiles(p, q, 5) if len(q) >= 5 else [(0, 0, len(q))] if q and p == q else []
            covered = sum(t[2] for t in tiles)
            if covered and covered >= tiling.need(len(q)):
                want.append((d, k, len(q), covered))
    got = D.op3_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.item_words, r.covered) for r in got) == sorted(want) and len(want) > 40


def test_contamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    clean = "no such words at all in this text but many others to be sure of it"
    docs = [
        (1, "before " + item + " after"), (2, "X. " + item.upper().replace(" ", ", ") + "!"), (3, " ".join(w[10:] + ["between"] * 5 + w[:10])), (4, " ".join(w[:6])), (5, clean), (6, None), (7, ""),
        (8, " ".join(x + " gap" for x in w)), (1, item), (9, " ".join(w[:12])),
    ]
    bench = [(0, item), (1, None), (2, "too short"), (3, "six words that stand here alone"), (4, "")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, coverage int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = D.contamination(d, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (1, 0), (2, 0), (3, 0), (9, 0)]
    two = next(r for r in got if r.doc_id == 3)
    assert two.covered == 20 and len(two.tiles) == 2
    small = D.contamination(d, b, block_chars=20)
    assert sorted((r.doc_id, r.item_id) for r in small.collect()) == sorted((r.doc_id, r.item_id) for r in got)
    kept = D.drop_contaminated(d, b, block_chars=20)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8]
    assert D.contamination(d, b.limit(0)).count() == 0 and D.drop_contaminated(d, b.limit(0)).count() == len(docs)
    assert D.contamination(d.limit(0), b).count() == 0


def hot_group(rng, n):
    """Near copies of one text, some so far from it that they hang on by others or not at all."""
    base = [f"h{i}" for i in range(60)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,percent,block", [(1, 80, 16), (2, 70, 10), (3, 88, 8)])
def test_large_groups_in_rounds(spark, seed, percent, block):
    rng = random.Random(seed)
    rows = list(enumerate(hot_group(rng, 140) + near_copies(rng, 30)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_components(rows, 3, percent)
    got = [tuple(r) for r in N.ngram_components(docs, join=N.Join(shingle=3, percent=percent, block=block, leaf=4, fan=2)).collect()]
    assert sorted(got) == sorted(want)
    assert len({c for _, _, c in want}) > 5


@pytest.mark.parametrize("bands,copies", [(64, 25), (6, 12)])
def test_copies_of_a_node_are_bounded(spark, monkeypatch, bands, copies):
    """A group of many blocks of which 40 % hang on late or not at all. With few bands its blocks count as
    too many, and several are put together where strays meet them."""
    rng = random.Random(6)
    base = [f"h{i}" for i in range(60)]
    texts = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.choice([0, 1]) if i < 120 else rng.choice([4, 5])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sent = []
    join_groups = N._join_groups
    monkeypatch.setattr(N, "_join_groups", lambda df, *a, **k: (sent.append(df.count()), join_groups(df, *a, **k))[1])
    join = N.Join(shingle=1, percent=86, block=8, bands=bands, miss=1e-8 if bands == 64 else 1e-3, leaf=4, fan=2)
    got = [tuple(r) for r in N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), join=join).collect()]
    want, _ = brute_components(rows, 1, 86)
    assert sorted(got) == sorted(want)
    assert sent[-1] <= copies * len(set(texts)), sent
