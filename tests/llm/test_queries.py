"""The registered queries as a whole: their SQL, their columns, the pipeline on awkward tables."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from phenospark.llm import language_id, queries
from tests.test_entry import duck, rows  # noqa: F401

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3": ["doc_id"],
    "op4": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id"],
    "op7": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op8": ["page_id", "host", "path", "rule", "verdict"],
    "op9": ["doc_id", "n_shingles", "component_id"],
    "op10": ["doc_id", "held_out", "lang_pred", "score"],
    "op11": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13": ["item_id", "rank", "doc_id", "score"],
}


@data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = rows([tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall()])
    assert rows([tuple(r[c] for c in sorted(cols)) for r in df.collect()]) == want


@data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs_over_its_whole_table(spark, name):
    n = name.split("_")[0]
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[n]) <= set(df.columns)
    table, key = ("pages", "page_id") if n == "op8" else ("documents", "doc_id")
    got = {r[0] for r in df.select(key).collect()}
    if n not in ("op3", "op13"):
        assert got == {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}


@data
def test_op1_fills_the_fewest_sequences(spark):
    got = queries.QUERIES["op1_best_fit_packing"](spark, SF).toPandas()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 2048).all() and (by.offset.first() == 0).all()
    assert all((g.offset.to_numpy()[1:] == (g.offset + g.length).to_numpy()[:-1]).all() for _, g in by)


def test_op10_against_brute_force(spark, tmp_path):
    """Bits by the stored weights, one document at a time; the codeword with the least weighted loss wins."""
    words = {"en": "the of and to in is that it was for", "de": "der die und in den von zu das mit sich", "fr": "le de un et la les des est que pour"}
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(words[la].split(), 12)), la) for i, la in enumerate(list(words) * 25)] + [(900, None, "en"), (901, "12 34", "de"), (902, "der", None)]
    spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, lang string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mod = lambda i: zlib.crc32(str(i).encode()) % 4
    model = language_id.fit_language_model(table.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"))
    got = {r.doc_id: r for r in queries.QUERIES["op10_language_id"](spark, str(tmp_path)).collect()}
    assert set(got) == {d for d, *_ in docs}
    for d, text, _ in docs:
        r = got[d]
        assert r.held_out == (mod(d) == 2)
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        f = language_id.features(text.encode()) @ model.weights[:-1] + model.weights[-1]
        loss = [sum(w * np.log1p(np.exp(-b * x)) for b, x, w in zip(c, f, model.trust)) for c in model.code]
        p = np.exp(-np.array(loss))
        assert r.lang_pred == model.languages[int(np.argmin(loss))] and abs(r.score - (p / p.sum()).max()) < 1e-3


def test_language_sample_does_not_depend_on_the_order(spark):
    base = [(f"the text number {i} of all", "en") for i in range(300)] + [(f"der Text Nummer {i} von allen", "de") for i in range(300)]
    one = language_id.fit_language_model(spark.createDataFrame(base, "text string, lang string"), per_language=40)
    two = language_id.fit_language_model(spark.createDataFrame(base[::-1] * 2, "text string, lang string").repartition(5), per_language=40)
    x = np.stack([language_id.features(t.encode()) for t, _ in base])
    assert one.decide(x)[0] == two.decide(x)[0] == [la for _, la in base]


def _tables(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, node string, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Null and empty texts, repeated rows, clashing names, a very long text; each stage on its own input."""
    rng = np.random.default_rng(3)
    good = lambda n: ". ".join(" ".join(rng.choice(["house", "river", "green", "walks", "under", "always", "tree"], 9)) for _ in range(n))
    item = " ".join(f"item{k}" for k in range(30))
    texts = [good(12) for _ in range(40)] + ["$$ !! @@ ## " * 40 for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (100, texts[0]), (101, texts[1] + " river"), (102, good(5) + " " + item + " " + good(5)), (103, None), (104, ""), (105, good(30_000)), (None, texts[2])]
    labels = [(i, int(i < 40), 0) for i in range(60)] + [(None, 1, 0)]
    _tables(spark, tmp_path, [(i, t, "en", "s", 1, "n", 0.5) for i, t in docs], labels, [(0, item), (1, None), (2, "")])
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == now.columns
        now = corpus_pipeline.materialize(out, "stage")
        ids[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in now.select("doc_id").collect())
    have = lambda name: [d for none, d in ids[name] if not none]
    assert set(range(40)) | {100, 101, 102, 105} <= set(have("quality_classifier")) and not set(range(40, 60)) & set(have("quality_classifier"))
    assert have("exact_dedup").count(100) == 1 and 0 not in have("exact_dedup") and (True, 0) not in ids["exact_dedup"]
    assert 101 not in have("ngram_jaccard_join") and {1, 100, 102} <= set(have("ngram_jaccard_join"))
    assert set(have("ngram_jaccard_join")) - set(have("benchmark_decontamination")) == {102}
    assert set(have("best_fit_packing")) == set(have("benchmark_decontamination")) and have("best_fit_packing").count(105) > 10
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in whole.select("doc_id").collect()) == ids["best_fit_packing"]


def test_pipeline_on_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    _tables(spark, tmp_path / "x", [(1, "some words here", "en", "s", 1, "n", 0.5)], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "x")).count() == 1
