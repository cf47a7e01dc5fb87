"""Forests as tables, snapshots of the feature store, intervals over many clusters."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.operators import metrics, models, trees
from phenospark.sources import feature_store


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(3)
    names = [f"f{i}" for i in range(12)]
    rows = []
    for i in range(600):
        x = [float(rng.random() < 0.3) for _ in names[:-1]] + [rng.random()]
        rows.append((i, *x, int(x[0] + x[3] * x[4] + x[11] + 0.3 * rng.random() > 0.9)))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names) + ", y int").cache()
    one = models.random_forest(df, names, "y", trees=15, depth=6, leaf=2)
    two = models.random_forest(df, names[:5], "y", trees=4, depth=3, seed=7)
    nodes = trees.forest_table(spark, one, "one", names).unionByName(trees.forest_table(spark, two, "two", names[:5])).cache()
    return df, names, one, two, nodes


def long_of(df, names):
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("v")) for n in names]))
    return df.select("id", each.alias("x")).select("id", "x.f", "x.v").filter("v != 0")


def test_forest_scores_equal_the_fitted_model(spark, forest):
    df, names, one, two, nodes = forest
    long = long_of(df, names).unionByName(spark.createDataFrame([(3, "unknown", 1.0), (4, None, 1.0), (5, "f1", None)], "id long, f string, v double"))
    got = {(r.id, r.model): r.p for r in trees.forest_scores(long, df.select("id").unionAll(df.select("id")), nodes, "id", "f", "v").collect()}
    assert len(got) == 1200
    for model, name in ((one, "one"), (two, "two")):
        for r in models.probability(model, df).select("id", "p").collect():
            assert abs(got[r.id, name] - r.p) < 1e-12
    assert trees.forest_scores(long, df.select("id").limit(0), nodes, "id", "f", "v").count() == 0


def test_forest_scores_count_what_is_used(spark, forest):
    *_, nodes = forest
    long = spark.createDataFrame([(1, "f0"), (1, "f0"), (1, "other"), (2, "f3")], "id long, f string")
    got = trees.forest_scores(long, spark.createDataFrame([(1,), (2,), (9,)], "id long"), nodes.filter("model = 'two'"), "id", "f")
    used = {f for (f,) in nodes.filter("model = 'two' and feature is not null").select("feature").distinct().collect()}
    assert {r.id: r.n_used for r in got.collect()} == {1: int("f0" in used), 2: int("f3" in used), 9: 0}
    broken = nodes.filter("model = 'two' and not (tree = 0 and node = 1)")
    with pytest.raises(ValueError):
        trees.forest_scores(long, long, broken, "id", "f")


def test_stored_genomes_are_looked_up(spark, forest, tmp_path):
    df, names, one, _, nodes = forest
    binary = long_of(df, names[:5]).select("id", "f")
    feature_store.write(binary, binary.withColumn("Type", F.lit("AMR")), f"{tmp_path}/store", "id", "f", ["Type"], df.select("id"))
    wanted = spark.createDataFrame([(1,), (2,), (10**6,)], "id long")
    got = {r.id: r for r in trees.stored_scores(feature_store.read(spark, f"{tmp_path}/store"), wanted, nodes.filter("model = 'two'"), "id", "f").collect()}
    want = {r.id: r.p for r in trees.forest_scores(binary, wanted, nodes.filter("model = 'two'"), "id", "f").collect()}
    assert {i: (r.found, r.p) for i, r in got.items()} == {1: (True, want[1]), 2: (True, want[2]), 10**6: (False, None)}


def test_a_snapshot_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    with pytest.raises(ValueError):
        feature_store.read(spark, path)
    long = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "a"), ("g1", "a")], "genome string, feature string")
    hits = spark.createDataFrame([("g1", "AMR", "POINT"), ("g3", "VIR", None)], "genome string, type string, subtype string")
    assert feature_store.write(long, hits, path, "genome", "feature", ["type", "subtype"]) == 1
    first = feature_store.read(spark, path)
    commit = feature_store._commit
    monkeypatch.setattr(feature_store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        feature_store.write(long.limit(1), hits, path, "genome", "feature", ["type"])
    monkeypatch.setattr(feature_store, "_commit", commit)
    assert feature_store.versions(spark, path) == [1] and feature_store.read(spark, path).manifest == first.manifest
    more = long.unionByName(spark.createDataFrame([("g4", "c")], long.schema))
    assert feature_store.write(more, hits, path, "genome", "feature", ["type"]) == 3  # 2 was claimed by the one that died
    assert sorted(map(tuple, first.long.collect())) == [("g1", "a"), ("g1", "b"), ("g2", "a")]  # pinned
    assert feature_store.read(spark, path, 1).manifest == first.manifest
    assert {k: first.manifest[k] for k in ("n_entities", "n_without_features", "n_values", "n_features", "n_hits", "version")} == {"n_entities": 3, "n_without_features": 1, "n_values": 3, "n_features": 2, "n_hits": 2, "version": 1}
    assert sorted(map(tuple, first.index.collect())) == [("g1", 2), ("g2", 1), ("g3", 0)]
    assert sorted(map(tuple, first.catalog.collect())) == [("a", 2), ("b", 1)]
    assert first.kinds.count() == 4
    assert len(feature_store.vacuum(spark, path, keep=1)) == 2 and feature_store.versions(spark, path) == [3]
    assert feature_store.read(spark, path).long.count() == 4


@pytest.mark.parametrize("metric", ["balanced_accuracy", "brier", "auroc"])
def test_resampled_intervals_agree_with_drawn_ones(spark, metric):
    rng = np.random.default_rng(2)
    rows = [(int(c), int(y), float(np.round(np.clip(0.5 + 0.25 * (y - 0.5) + 0.1 * (c % 7 - 3) / 3 + 0.15 * rng.normal(), 0, 1), 3))) for c in range(120) for y in rng.integers(0, 2, 8)]
    df = spark.createDataFrame(rows, "c long, y int, p double").repartition(5)
    one, two = metrics.bootstrap_ci(df, "c", metric=metric, draws=1500), metrics.resampled_ci(df, "c", metric=metric, draws=1500)
    width = one[1] - one[0]
    assert abs(one[0] - two[0]) < 0.2 * width and abs(one[1] - two[1]) < 0.2 * width
    assert metrics.resampled_ci(df.repartition(2), "c", metric=metric, draws=1500) == pytest.approx(two, abs=1e-12)  # no matter how rows lie
    if metric == "auroc":
        rough = metrics.resampled_ci(df, "c", metric=metric, draws=1500, bins=64)
        assert abs(rough[0] - two[0]) < 0.1 * width + 0.003


def test_resampled_intervals_that_cannot_be_told(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (None, 1, 0.2)], "c long, y int, p double")
    assert metrics.resampled_ci(df, "c") is None
    assert metrics.resampled_ci(df.filter("y = 1"), "c") is None
    with pytest.raises(ValueError):
        metrics.resampled_ci(df, "c", metric="f1")


def test_draws_are_poisson_of_mean_one():
    t = metrics._times(np.arange(4000, dtype=np.uint64) * np.uint64(7919), 50, 3)
    assert abs(t.mean() - 1) < 0.02 and abs(t.var() - 1) < 0.03
    share = [(t == k).mean() for k in range(4)]
    assert np.allclose(share, [0.3679, 0.3679, 0.1839, 0.0613], atol=0.01)
    assert abs(np.corrcoef(t[:, 0], t[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(t[:-1, 0], t[1:, 0])[0, 1]) < 0.06


def test_documents_and_citations_of_little(spark):
    import json

    from phenospark.operators import evidence, store

    genomes = spark.createDataFrame([("g1", "train"), ("g2", None)], "g string, split string")
    drugs = spark.createDataFrame([("g1", "b", 0.5), ("g1", "a", None), ("x", "a", 1.0)], "g string, drug string, p double")
    hits = spark.createDataFrame([], "g string, sym string")
    got = {r.g: json.loads(r.value) for r in store.genome_documents(genomes, {"drugs": (drugs, "drug", ["p"]), "hits": (hits, None, ["sym"])}, "g", ["split"]).collect()}
    assert got == {"g1": {"split": "train", "drugs": {"a": {}, "b": {"p": 0.5}}, "hits": []}, "g2": {"drugs": {}, "hits": []}}
    rules = spark.createDataFrame([("d", "one", ["r2", "r1", "r9"]), ("d", "none", []), ("d", "null", None)], "drug string, rule string, refs array<string>")
    sources = spark.createDataFrame([("r1", None, "T; x"), ("r2", " C ;y", "T"), ("r2", "D", None)], "ref string, cite string, title string")
    rows = spark.createDataFrame([(1, "d", "one"), (2, "d", "none"), (3, "d", "null"), (4, "e", "one")], "i int, drug string, rule string")
    assert {r.i: r.citations for r in evidence.with_citations(rows, rules, sources).collect()} == {1: ["C", "T", "r9"], 2: [], 3: [], 4: []}
