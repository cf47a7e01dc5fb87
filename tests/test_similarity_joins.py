"""Exact joins of similar things at scale, against all pairs or the matrix version."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phenospark.operators import gates, graph, linkage, minimizers, pivots, signature_join, similarity, splits


def clustered(seed, n, dims, centres, spread):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))
    return x


@pytest.mark.parametrize("seed, n, centres, spread, least, block", [(1, 700, 12, 0.3, 0.9, 40), (2, 500, 3, 1.0, 0.5, 50), (3, 300, 300, 1.0, 0.3, 32), (4, 400, 1, 0.05, 0.99, 30)])
def test_pivot_join_equals_all_pairs(spark, seed, n, centres, spread, least, block):
    x = clustered(seed, n, 8, centres, spread)
    x[5:45] = x[4]  # a group of copies larger than a block
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(n, None, 1), (n + 1, [0.0] * 8, 1), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(data, "id long, v array<double>, unit int").repartition(5)
    got = {(r.a, r.b): r.cosine for r in pivots.similar_pairs(df, "id", "v", least, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    want = {(int(a), int(b)): cos[a, b] for a, b in zip(*np.nonzero(np.triu(cos >= least, 1)))}
    unsure = {p for p in set(got) ^ set(want) if abs(cos[p] - least) < 1e-12}
    assert set(got) - unsure == set(want) - unsure
    assert all(abs(got[p] - cos[p]) < 1e-12 for p in got)


def test_rows_travel_less_than_blocks(spark):
    x = clustered(5, 6000, 8, 60, 0.12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    blocks = -(-6000 // 100)
    assert 1 <= pivots.travel(df, "id", "v", 0.97, block=100) < blocks / 6


def test_pivot_join_on_empty_tables(spark):
    df = spark.createDataFrame([], "id string, v array<float>")
    assert pivots.similar_pairs(df, "id", "v", 0.5).count() == 0
    with pytest.raises(ValueError):
        pivots.similar_pairs(df, "id", "v", 0.0)


def test_nearest_by_pivots(spark):
    x = clustered(6, 400, 6, 8, 0.4)
    x /= np.linalg.norm(x, axis=1, keepdims=True) * 1.2
    x[10] = x[11] = x[12]
    g = np.arange(400) % 3
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, g))], "id long, v array<double>, g long").repartition(4)
    got = {r.id: (r.best, r.dot) for r in pivots.nearest(df, 0.55, block=30).collect()}
    dot = np.where((g[:, None] == g) & ~np.eye(400, dtype=bool), x @ x.T, -1)
    for i in range(400):
        top = dot[i].max()
        assert (i in got) == (top >= 0.55)
        if i in got:
            assert abs(got[i][1] - top) < 1e-12 and dot[i][got[i][0]] >= top - 1e-12


def test_rows_without_clusters_travel_as_blocks_do(spark):
    x = np.random.default_rng(6).normal(size=(2400, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    assert pivots.travel(df, "id", "v", 0.35, block=40) <= similarity.BLOCKS + 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert pivots.similar_pairs(df, "id", "v", 0.35, block=40).count() == (np.triu(u @ u.T, 1) >= 0.35).sum() > 0


def test_blocks_of_all_with_all_do_not_grow_with_the_rows():
    assert [similarity.blocks_of(n, 64, 2048) for n in (0, 5000, 60_000, 600_000)] == [1, 3, 16, 16]
    assert similarity.blocks_of(6_000_000, 64, 2048) == 92  # of 32 MB each


@pytest.mark.parametrize("repeated", [False, True])
def test_edges_know_their_ends(spark, repeated):
    x = clustered(8, 200, 6, 9, 0.5)
    rows = [(i // 2 if repeated else 199 - i, f"s{i % 3}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, split string, v array<float>").repartition(5)
    e = similarity.cosine_edges(df, "id", "v", 0.6, block=40, keep=["split"])
    u = np.array([r[2] for r in rows], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.6, 1))) if rows[i][0] != rows[j][0]}
    got = e.collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 100
    if not repeated:
        split = {k: s for k, s, _ in rows}
        assert all((r.split_a, r.split_b) == (split[r.a], split[r.b]) for r in got)
        plain = similarity.cosine_edges(df, "id", "v", 0.6)
        s = df.withColumn("group", df.id % 7).select("id", "group", "split")
        assert splits.audit_of_marked(e, s, "cosine", "split", "group", "split", 0.8).first() == splits.leakage_audit(plain, s, "a", "b", "cosine", "id", "group", "split", 0.8).first()
        near = similarity.nearest_of_marked(similarity.cosine_edges(df.withColumn("t", F.col("split") == "s0"), "id", "v", 0.6, keep=["t"]), df, "a", "b", "cosine", "t", "id")
        assert sorted(near.collect()) == sorted(similarity.nearest_in_train(plain, df.filter("split = 's0'"), df, "a", "b", "cosine", "id").collect())


def test_pairs_of_one_mark_are_not_compared(spark):
    x = clustered(8, 300, 6, 9, 0.5)
    df = spark.createDataFrame([(i * 7 % 300, f"s{i % 3}" if i % 10 else None, v.tolist()) for i, v in enumerate(x)], "id int, split string, v array<double>").repartition(5)
    marked = similarity.cosine_edges(df, "id", "v", 0.6, block=70, keep=["split"])
    apart = similarity.cosine_edges(df, "id", "v", 0.6, block=70, keep=["split"], apart="split")
    want = sorted(tuple(r)[:2] + tuple(r)[3:] for r in marked.filter("split_a != split_b").collect())
    assert sorted(tuple(r)[:2] + tuple(r)[3:] for r in apart.collect()) == want and 100 < len(want) < marked.count()
    alike = df.withColumn("split", F.lit("s"))
    assert similarity.cosine_edges(alike, "id", "v", 0.6, block=70, keep=["split"], apart="split").count() == 0


def test_a_task_contracts_its_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "CONTRACT_EDGES", 50)
    rng = np.random.default_rng(2)
    pairs = [(f"n{g}-{a}", f"n{g}-{b}") for g in range(5) for a, b in rng.integers(0, 40, (400, 2))]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    assert graph._contract(df).count() <= 200
    roots = {r.node: r.root for r in graph.connected_components(df, "a", "b").collect()}
    assert len(roots) == len({n for p in pairs for n in p}) and all(roots[n] == min(m for m in roots if m[:3] == n[:3]) for n in roots)


def test_a_hub_is_contracted_in_few_rounds():
    import time

    node, hub = pa.chunked_array([np.arange(1, 60_000)]), pa.chunked_array([np.zeros(59_999, np.int64)])
    began = time.time()
    star = graph._star(node, hub)
    assert star.num_rows == 59_999 and time.time() - began < 5  # a minute with a round for each neighbour


@pytest.mark.parametrize(("clusters", "noise"), [(1, 9.0), (4, 0.2), (30, 0.4)])
def test_links_of_blocks_give_the_components_of_all_pairs(spark, clusters, noise):
    x = clustered(11, 700, 8, clusters, noise)
    df = spark.createDataFrame([(f"n{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>").repartition(5)
    links = similarity.cosine_links(df, "id", "v", 0.9, block=120)
    blocks = similarity.blocks_of(700, 8, 120)
    assert links.count() < 700 * blocks
    of = lambda e: {(r.node, r.root) for r in graph.connected_components(e, "a", "b", df, "id").collect()}
    assert of(links) == of(similarity.cosine_edges(df, "id", "v", 0.9, block=120))


def test_parts_of_blocks_of_many_strips():
    x = np.random.default_rng(4).normal(size=(1500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = np.arange(1500)
    for left, right, least in ((rows, None, 0.75), (rows[:400], rows[400:], 0.75), (rows[:1100], rows[1100:], 0.8), (rows[:300], rows[300:], 2.0)):
        hit = x @ x.T >= least
        right = left if right is None else right
        want = np.arange(1500)
        graph.link(want, *(side[k] for side, k in zip((left, right), np.nonzero(hit[np.ix_(left, right)]))))
        assert similarity.linked_parts(x, left, right, least).tolist() == want.tolist()


# ---------------------------------------------------------------- average linkage in rounds


def parts(rows):
    out = {}
    for g, n, c in rows:
        out.setdefault((g, c), []).append(n)
    return sorted((g if g is not None else -1, sorted(ns)) for (g, _), ns in out.items())


def by_matrix(x, groups, cut):
    rows = []
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for g in set(groups):
        at = [i for i, k in enumerate(groups) if k == g]
        found = similarity.average_linkage(1 - u[at] @ u[at].T, cut)
        rows += [(g, i, int(c)) for i, c in zip(at, found)]
    return rows


@pytest.mark.parametrize("seed, tail", [(1, 12), (2, 80)])
def test_linkage_by_rounds_equals_the_matrix(spark, seed, tail):
    x = clustered(seed, 260, 6, 14, 0.5)
    x[20:60] = x[20]
    x[100] = 0
    groups = [None if i % 50 == 7 else i % 2 for i in range(260)]
    df = spark.createDataFrame([(g, i, v.tolist()) for i, (g, v) in enumerate(zip(groups, x))], "g int, n long, e array<double>").repartition(4)
    want = parts(by_matrix(x, groups, 0.25))
    got = linkage.by_rounds(df, "g", "n", "e", 0.25, tail=tail, block=40)
    assert parts(map(tuple, got.collect())) == want
    assert all(r.root <= r.n for r in got.withColumnRenamed("node", "n").collect())


def test_large_groups_are_no_task(spark):
    x = clustered(4, 300, 6, 10, 0.4)
    groups = [0 if i < 220 else 1 + i % 3 for i in range(300)]
    df = spark.createDataFrame([(g, i, None if i == 5 else v.tolist()) for i, (g, v) in enumerate(zip(groups, x))], "g int, n long, e array<double>")
    one = similarity.linkage_vectors(df, "g", "n", "e", 0.2).collect()
    two = similarity.linkage_vectors(df, "g", "n", "e", 0.2, largest=50).collect()
    assert parts(map(tuple, one)) == parts(map(tuple, two))
    for rows in (one, two):
        numbers = {}
        for r in rows:
            numbers.setdefault(r.g, set()).add(r.cluster)
        assert all(s == set(range(len(s))) for s in numbers.values())
    assert similarity.linkage_vectors(df.limit(0), "g", "n", "e", 0.2).count() == 0


def test_large_groups_may_be_named_root(spark):
    x = clustered(4, 120, 6, 8, 0.4)
    df = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)], "root int, node long, e array<double>")
    one = similarity.linkage_vectors(df, "root", "node", "e", 0.2).collect()
    two = similarity.linkage_vectors(df, "root", "node", "e", 0.2, largest=50)
    assert two.columns == ["root", "node", "cluster"] and parts(map(tuple, one)) == parts(map(tuple, two.collect()))


# ---------------------------------------------------------------- signatures, probes


def signatures(seed, n, size):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, (6, size))
    x = base[rng.integers(0, 6, n)]
    change = rng.random((n, size)) < rng.choice([0.02, 0.1, 0.4], n)[:, None]
    x = np.where(change, rng.integers(0, 1 << 60, (n, size)), x)
    x[:, 0] = 7  # a token that all have
    x[10:50] = x[10]
    return x


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("seed, least, block", [(1, 26, 512), (2, 20, 9), (3, 32, 16), (4, 1, 64)])
def test_prefix_join_equals_all_pairs(spark, monkeypatch, seed, least, block, clash):
    if clash:  # places have the same tokens, also within a signature
        monkeypatch.setattr(signature_join, "_tokens", lambda x: x.astype(np.uint64) % np.uint64(50))
    x = signatures(seed, 220, 32)
    df = spark.createDataFrame([(f"g{i:03}", row.tolist()) for i, row in enumerate(x)] + [("none", None)], "g string, sig array<long>").repartition(5)
    of = signature_join.classes(df, "g", "sig")
    got = {(r.a, r.b): r.agree for r in signature_join.agreeing_pairs(of, least, block).collect()}
    reps = {}
    for i, row in enumerate(x):
        reps.setdefault(tuple(row), f"g{i:03}")
    items = list(reps.items())
    want = {}
    for i, (s, a) in enumerate(items):
        for t, b in items[i + 1 :]:
            n = sum(p == q for p, q in zip(s, t))
            if n >= least:
                want[a, b] = n
    assert got == want
    assert {(r.rep, r.id) for r in signature_join.members(df, "g", "sig", of).collect()} == {(reps[tuple(row)], f"g{i:03}") for i, row in enumerate(x)}


def test_signatures_travel_as_a_byte_a_place(spark):
    x = signatures(5, 120, 32)
    of = signature_join.classes(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "g long, sig array<long>"), "g", "sig")
    bands = signature_join._Bands(x, 7)
    rows = signature_join.dealt(of, bands, 4096, 3).collect()
    assert len(rows) == 7 * of.count() and all(len(r.codes) == 32 and r.low == r.high == 0 for r in rows)
    few = signature_join.dealt(of, bands, 3, 3).collect()
    assert {(r.rep, r.key) for r in few} == {(r.rep, r.key) for r in rows} and max(r.high for r in few) > 0


def test_prefix_join_of_nothing(spark):
    of = signature_join.classes(spark.createDataFrame([(1, None)], "g long, sig array<long>"), "g", "sig")
    assert signature_join.agreeing_pairs(of, 3).count() == 0
    assert signature_join.least_agreement(0.01, 21, 128) == next(n for n in range(129) if n and -np.log(2 * n / 128 / (1 + n / 128)) / 21 <= 0.01)


@pytest.mark.parametrize("group_bytes, group_probes", [(4_000_000, 200_000), (300, 20)])
def test_probes_by_minimizers(spark, monkeypatch, group_bytes, group_probes):
    monkeypatch.setattr(minimizers, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(minimizers, "GROUP_PROBES", group_probes)
    rng = np.random.default_rng(3)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    loci = [dna(120) for _ in range(6)] + ["A" * 90]
    seqs = [dna(200) + loci[i % 7][: 40 + 10 * (i % 6)] + dna(50) for i in range(40)] + ["A" * 5000, "N" * 100, "ACGT", "", None, loci[0].lower(), loci[1][:60] + "N" + loci[1][60:]]
    contigs = spark.createDataFrame([(i // 2, s) for i, s in enumerate(seqs)] + [(0, seqs[0])], "genome long, seq string").repartition(4)
    comp = str.maketrans("ACGT", "TGCA")
    ref = sorted({(f"l{j}", strand, k) for j, s in enumerate(loci) for i in range(0, len(s) - 20, 7) for strand, k in (("fwd", s[i : i + 21]), ("rc", s[i : i + 21].translate(comp)[::-1]))})
    panel = spark.createDataFrame(ref, "locus string, strand string, kmer string")
    want = {(i // 2, x, strand, k) for i, s in enumerate(seqs) for x, strand, k in ref if k in (s or "")}
    assert {tuple(r) for r in minimizers.probe_hits(contigs, "genome", panel).collect()} == want and len(want) > 100
    dense = {(r.genome, r.locus): r.share for r in gates.kmer_share(contigs, "genome", panel).collect() if r.share}
    assert {(r.genome, r.locus): r.share for r in minimizers.kmer_shares(contigs, "genome", panel).collect()} == dense


def test_minimizers_are_those_of_the_windows():
    rng = np.random.default_rng(1)
    s = "".join(rng.choice(list("ACGTN"), 400, p=[0.24, 0.24, 0.24, 0.24, 0.04])).encode()
    least, good = minimizers.minimizers(s, 21)
    for i in range(len(s) - 20):
        assert good[i] == (b"N" not in s[i : i + 21])
        if good[i]:
            assert least[i] == minimizers.minimizers(s[i : i + 21], 21)[0][0]
    wanted = np.ones(4**11, bool)
    covered = [p for a, b, x in minimizers.runs(s, 21, wanted) for p in range(a, b - 20)]
    assert covered == np.flatnonzero(good).tolist()


def test_probes_of_another_kind_are_refused(spark):
    contigs = spark.createDataFrame([(1, "ACGT" * 20)], "genome long, seq string")
    for kmers in (["ACG"], ["ACGTACGTACGTN"], ["ACGTACGTACGT", "ACGTACGTACGTA"]):
        with pytest.raises(ValueError):
            minimizers.probe_hits(contigs, "genome", spark.createDataFrame([("l", "fwd", k) for k in kmers], "locus string, strand string, kmer string"))
    assert minimizers.probe_hits(contigs, "genome", spark.createDataFrame([], "locus string, strand string, kmer string")).count() == 0
