"""The pipeline on whole small tables, stage by stage, against brute force or properties."""

from __future__ import annotations

import os
import re
import zlib

import pytest

import corpus_pipeline
from phenospark.llm import packing
from tests.llm.test_ngram_decontam import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        out.append(docs.collect())
    return out


def test_names_and_columns(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for rows in steps[1:-1]:
        assert rows[0].__fields__ == steps[0][0].__fields__
    for a, b in zip(steps[:-2], steps[1:-1]):
        assert {r.doc_id: r for r in b}.items() <= {r.doc_id: r for r in a}.items()


def test_quality_keeps_good_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1]}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((i in kept) == (labels[i] == 1) for i in held) >= 0.9 * len(held)
    assert len(kept) >= 0.8 * len(steps[0])


def test_exact_stage(steps):
    best = {}
    for r in steps[1]:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in steps[2]) == sorted(best.values())


def test_near_stage(steps):
    rows = [(r.doc_id, r.text) for r in steps[2]]
    want, _ = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in steps[3]) == sorted(d for d, n, c in want if d == c)


def test_benchmark_stage(spark, steps):
    norm = lambda t: re.sub(r"[^\w\s]", "", t.lower()).split()
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in steps[4]}
    for r in steps[3]:
        w = f" {' '.join(norm(r.text))} "
        holds = any(f" {' '.join(i)} " in w for i in items)
        if holds or not any(f" {' '.join(i[k : k + 5])} " in w for i in items for k in range(len(i) - 4)):
            assert (r.doc_id in kept) != holds


def test_packing_stage(spark, steps):
    enc = packing.encoder("byte_bpe_50k")
    tokens = {r.doc_id: len(enc.ids(r.text or "")) + 1 for r in steps[4]}
    got = {}
    for r in steps[5]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens
    used = {r.sequence_id for r in steps[5]}
    assert len(used) <= -(-sum(tokens.values()) // 2048) + 2
    assert corpus_pipeline.run(spark, SF).count() == len(steps[5])
