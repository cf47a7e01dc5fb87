"""Training and evaluation as a whole, the clean-label job, splits, readers and sinks beside the catalogue."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.functions import scoring as S
from phenospark.operators import cleaning, labels, metrics, nocall, similarity, splits, store, training
from phenospark.sources import readers, writers


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for drug, share_cal in (("a/b", 0.5), ("few", 0.025), ("none", 0.0)):
        for i in range(400):
            split = rng.choice(["train"] * 5 + ["calibration"] * 2 + ["test", "heldout_group"])
            y = int(rng.random() < (share_cal if split == "calibration" else 0.5 if drug != "none" else 0.0))
            out.append((drug, f"g{i}", y, split, i % 40, rng.gauss(2.0 * y, 1.0), rng.random(), rng.random() * 10))
    return spark.createDataFrame(out, "drug string, entity string, y int, split string, cluster int, x1 double, x2 double, distance double").cache()


def test_train_save_load_score_and_delete_stale(spark, rows, tmp_path):
    folder = str(tmp_path / "models")
    fitted, scores, summary = training.train_all(rows, ["x1", "x2"], folder=folder)
    got = {r.drug: (r.status, r.calibration) for r in summary.collect()}
    assert got["a/b"] == ("trained", "platt") and got["few"] == ("trained", "shift") and got["none"][0] == "single_class_training"
    assert fitted["few"].tau is not None and fitted["a/b"].distance_threshold > 9
    again = training.load_all(spark, folder)
    assert set(again) == {"a/b", "few"} and again["a/b"].meta() == fitted["a/b"].meta()
    own = rows.filter("drug = 'a/b'")
    one = {r.entity: (r.p, r.reason) for r in fitted["a/b"].score(own).collect()}
    two = {r.entity: (r.p, r.reason) for r in again["a/b"].score(own).collect()}
    assert one == two and {r for _, r in one.values()} >= {"called", "ani_ood"}
    test = scores.filter("drug = 'a/b' and split = 'test'")
    assert metrics.auroc(test, ["drug"]).first().auroc > 0.8
    (tmp_path / "models" / "metrics.json").write_text("{}")
    other = tmp_path / "models" / "my_other_data" / "meta"
    other.mkdir(parents=True)
    (other / "part-0.txt").write_text('{"drug": "a/b"}\n')
    twin = training.load_bundle(spark, f"{folder}/{training.bundle_name('a/b')}")
    twin.drug = "a_b"
    training.save_bundle(twin, spark, folder)
    assert set(training.load_all(spark, folder)) == {"a/b", "a_b", "few"}
    assert training.delete_stale(spark, folder, ["few", "a_b"]) == ["a/b"] and set(training.load_all(spark, folder)) == {"few", "a_b"}
    assert (tmp_path / "models" / "metrics.json").exists() and (other / "part-0.txt").exists()
    with pytest.raises(ValueError):
        training.load_bundle(spark, f"{folder}/my_other_data")
    assert len({training.bundle_name(d) for d in ("a/b", "a_b", "a b", "a%2Fb", ".", "..", "", "A/B")}) == 8
    assert training.train_all(rows.limit(0), ["x1", "x2"])[1].count() == 0


def test_training_rows_keeps_first_and_joins(spark):
    lab = spark.createDataFrame([("g1", "d", 1, 2), ("g1", "d", 0, 1), ("g2", "d", 1, 3), ("g3", "d", 1, 4)], "entity string, drug string, y int, position int")
    feats = spark.createDataFrame([("g1", 0.5), ("g2", 0.1)], "entity string, x double")
    spl = spark.createDataFrame([("g1", "train", 1), ("g3", "test", 2)], "entity string, split string, cluster int")
    assert [(r.entity, r.y, r.x, r.split) for r in training.training_rows(lab, feats, spl, "entity", "drug", "position").collect()] == [("g1", 0, 0.5, "train")]


def test_evaluate_all_as_one_document(spark, rows):
    p = rows.select("drug", "entity", (1 / (1 + F.exp(-(F.col("x1") - 1)))).alias("p"))
    lab = rows.select("drug", "entity", "y")
    spl = rows.filter("drug = 'few'").select("entity", "cluster", "split")
    calls = rows.select("drug", "entity", (F.col("distance") > 8).alias("no_call"))
    got = metrics.evaluate_all(p.filter("drug != 'none'"), lab, spl, calls, draws=60)
    json.dumps(got)
    d = got["a/b"]
    assert d["n_labeled"] == 400 and set(d["splits"]) == {"train", "calibration", "test", "heldout_group"} and set(d["groups"]) == {"seen", "heldout_group"}
    part = [r for r in rows.filter("drug = 'a/b'").join(spl.withColumnRenamed("split", "s").drop("cluster"), "entity").join(p.filter("drug = 'a/b'").drop("drug"), "entity").collect() if r.s == "test"]
    block = d["splits"]["test"]
    assert block["n"] == len(part) and math.isclose(block["brier"], sum((r.p - r.y) ** 2 for r in part) / len(part))
    rec = lambda v: sum((r.p >= 0.5) == v for r in part if r.y == v) / sum(r.y == v for r in part)
    assert math.isclose(block["balanced_accuracy"], (rec(1) + rec(0)) / 2)
    pos, neg = [r.p for r in part if r.y == 1], [r.p for r in part if r.y == 0]
    assert math.isclose(block["auroc"], sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    called = [r for r in part if r.distance <= 8]
    assert block["n_called"] == len(called) == block["n_called"] and block["n_called"] < block["n"]
    for metric in ("balanced_accuracy", "auroc", "brier"):
        lo, hi = block[f"{metric}_ci95_over_clusters"]
        assert lo <= block[metric] <= hi
    assert len(block["reliability"]) == 10 and sum(b["n"] for b in block["reliability"]) == len(part) and len(block["risk_coverage"]) == 20


def test_bootstrap_is_undefined_for_one_class_or_cluster(spark):
    one = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "cluster int, y int, p double")
    alone = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.7)], "cluster int, y int, p double")
    for metric in ("balanced_accuracy", "auroc", "brier"):
        assert metrics.bootstrap_ci(one, "cluster", metric=metric) is None and metrics.bootstrap_ci(alone, "cluster", metric=metric) is None
    with pytest.raises(ValueError):
        metrics.bootstrap_ci(one, "cluster", metric="other")


def test_benchmark_run_and_report(spark):
    cols = "drug string, n_entities int, n_test int, n_r int, n_s int, balanced_accuracy double"
    table, code = metrics.benchmark_run(metrics.benchmark_status(spark.createDataFrame([("a", 200, 20, 5, 5, 0.9), ("b", 50, 20, 5, 5, 0.7), ("c", 200, 20, 5, 5, None)], cols)))
    r = table.first()
    assert math.isclose(r.mean_balanced_accuracy, 0.8) and (r["pass"], r.warn, r.status, code) == (2, 1, "warn", 0)
    assert metrics.benchmark_run(metrics.benchmark_status(spark.createDataFrame([("a", 0, 0, 0, 0, None)], cols)))[1] == 1
    assert metrics.benchmark_run(metrics.benchmark_status(spark.createDataFrame([], cols)))[1] == 1
    per = spark.createDataFrame([("a", 100, 40, 30, 10, 20, 0.8), ("b", 100, 2, 4, 0, 4, None), ("c", 100, 40, 30, 10, 20, 0.0)], "drug string, n_train int, train_r int, n_test int, test_r int, test_s int, recall_resistant double")
    skipped = spark.createDataFrame([("d", "no_amrfinder_features")], "drug string, skip_reason string")
    got = {r.drug: (r.training_status, r.passes_eval, r.quality_status, r.cohort_issue) for r in metrics.evaluation_report(per, skipped, 50).collect()}
    assert got == {"a": ("trained", True, "pass", "few_entities"), "b": ("trained", False, "warn", "few_entities"), "c": ("trained", False, "warn", "few_entities"), "d": ("skipped", False, None, "few_entities")}


def test_bands_and_gates_round_trip(spark, tmp_path):
    bands = spark.createDataFrame([("a", 0.2, 0.19, 0.2, 0.81, 90.1), ("b", 0.1, 0.3, 0.1, 0.7, None)], "drug string, q_s double, q_r double, low double, high double, distance_threshold double")
    nocall.save_bands(bands, str(tmp_path / "bands"))
    got = nocall.load_bands(spark, str(tmp_path / "bands"))
    assert sorted(got.select(*bands.columns).collect()) == sorted(bands.collect())
    status = spark.createDataFrame([("a", "g.10", "pass"), ("a", "g2", "not_callable"), ("b", "g2", "absence_of_evidence")], "drug string, genome_id string, status string")
    assert sorted(nocall.read_envelope(nocall.gate_envelope(status)).collect()) == sorted(status.collect())


# ---------------------------------------------------------------- splits


@pytest.mark.parametrize("seed", range(5))
def test_stratified_assign_keeps_shares_and_classes(seed):
    rng = random.Random(seed)
    clusters = [(c, rng.randint(1, 6), rng.choice([0, 0, 1, None])) for c in range(300)]
    got = splits.stratified_assign(clusters, seed=seed)
    assert set(got) == set(range(300)) and got == splits.stratified_assign(clusters, seed=seed)
    total = sum(n for _, n, _ in clusters)
    size = {s: sum(n for c, n, _ in clusters if got[c] == s) / total for s in splits.K.SPLIT_SHARES}
    assert size["train"] == max(size.values()) and size["train"] > 0.55 and min(size.values()) > 0.08, size
    share = lambda s: np.mean([y for c, _, y in clusters if got[c] == s and y is not None])
    assert abs(share("train") - share("test")) < 0.15


def test_folds_and_peel():
    folds = splits.stratified_folds([(c, c % 2) for c in range(43)], 7, 1)
    for f in range(7):
        for y in (0, 1):
            assert 3 <= sum(folds[c] == f and c % 2 == y for c in range(43)) <= 4
    got = splits.peel_folds({0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 5: 10, 6: 10}, splits.K.SPLIT_SHARES)
    assert sorted(got.values()).count("train") == 3 and set(got) == set(range(7))
    assert set(splits.peel_folds({0: 5, 1: 1, 2: 1}, splits.K.SPLIT_SHARES).values()) == set(splits.K.SPLIT_SHARES)
    few = splits.stratified_assign([(c, 5, 1) for c in range(20)])  # one class: by size alone
    assert few == splits.greedy_assign([(c, 5) for c in range(20)], seed=0)


# ---------------------------------------------------------------- labels


def test_clean_label_job_and_its_audit(spark):
    head = cleaning.RAW_COLUMNS
    base = dict.fromkeys(head, "") | {"Genome ID": "562.10", "Antibiotic": "Ciprofloxacin", "Evidence": "Laboratory Method", "Measurement Unit": "mg/L", "Laboratory Typing Method": "MIC", "Testing Standard": "EUCAST"}
    case = lambda **k: tuple((base | {a.replace("_", " "): b for a, b in k.items()})[c] for c in head)
    raw = spark.createDataFrame(
        [
            case(Measurement_Sign="<=", Measurement_Value="0.25", Resistant_Phenotype="Resistant", Testing_Standard_Year="2018"),
            case(Measurement_Value="4", Resistant_Phenotype="Resistant", Testing_Standard_Year="2020"),
            case(Genome_ID="562.2", Resistant_Phenotype="Susceptible"), case(Genome_ID="562.2", Resistant_Phenotype="Resistant"),
            case(Genome_ID="562.3", Antibiotic="tetracyklin", Resistant_Phenotype="Susceptible", Laboratory_Typing_Method="Disk diffusion"),
            case(Genome_ID="562.3", Antibiotic="snake oil", Resistant_Phenotype="Susceptible"),
            case(Genome_ID="562.4", Resistant_Phenotype="Intermediate", Testing_Standard_Year="2021"),
            case(Genome_ID="562.5", Measurement_Value="4", Measurement_Unit="mm", Resistant_Phenotype="Susceptible"),
            case(Genome_ID="562.6", Evidence="Computational Method", Resistant_Phenotype="Resistant"),
            case(Genome_ID="562.7", Antibiotic="neomycin", Measurement_Value="4"),
        ],
        ", ".join(f"`{c}` string" for c in head),
    )
    job = cleaning.clean_labels(raw, cleaning.default_names(spark), cleaning.limit_table(spark, {"ciprofloxacin": (0.25, 0.5)}))
    got = {(r.genome_id, r.antibiotic): (r.label, r.label_source, r.testing_standard_year, r.n_source_rows) for r in job.labels.collect()}
    assert got == {("562.10", "ciprofloxacin"): (1, "rederived", 2020, 2), ("562.3", "tetracycline"): (0, "submitted", None, 1), ("562.5", "ciprofloxacin"): (0, "submitted", None, 1)}
    tables = dict(cleaning.audit(job))
    assert len(tables) == 10
    one = lambda name: [tuple(r) for r in tables[next(k for k in tables if k.startswith(name))].collect()]
    assert one("1.") == [(10, 1, 6, "")]
    assert one("5.") == [("snake oil", "(untrusted)", 1), ("tetracyklin", "tetracycline", 1)]
    assert ("ciprofloxacin", 2, 0, 1, 2, 0.5) in one("7.") and ("neomycin", 1, 1, None, None, None) in one("7.")
    assert dict(one("9.")) == {"empty": 2, "tie": 1, "unanimous": 3}
    text = writers.markdown_report("Label audit", cleaning.audit(job))
    assert text.count("\n## ") == 10
    lacking = cleaning.clean_labels(raw.drop("Measurement", "Evidence"), cleaning.default_names(spark), cleaning.limit_table(spark, {}))
    assert lacking.missing == ["Measurement", "Evidence"] and lacking.labels.count() == 0
    assert cleaning.clean_labels(raw.limit(0), cleaning.default_names(spark), cleaning.limit_table(spark, {})).labels.count() == 0


def test_rank_groups(spark):
    rows = [(sp, d, f"{sp}{i}", i % 2) for sp, d, n in (("x", "d1", 10), ("x", "d2", 2), ("y", "d1", 12), ("y", "d2", 10), ("z", "d1", 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "species string, drug string, genome string, label int")
    got = [(r.species, r.n_good, r.priority_rank, r.size_penalty, r.good) for r in labels.rank_groups(df, "species", "drug", "genome", "label", ["z"], 5, 10, (11, 15)).collect()]
    assert got == [("y", 2, 999, 0, ["d1", "d2"]), ("z", 1, 0, 5, ["d1"]), ("x", 1, 999, 1, ["d1"])]


# ---------------------------------------------------------------- readers, signatures, texts, documents


def test_checked_hits_sets_bad_files_apart(spark, tmp_path):
    head = "\t".join(readers.HIT_COLUMNS)
    (tmp_path / "562.10.tsv").write_text(head + "\nblaX\tn\tAMR\tBETA\tB\tEXACTX\nNA\tn\tAMR\tna\tB\tHMM\nNA\t\t na \tBETA\tB\tNa\n\tna\t\tBETA\tB\tHMM\n")
    (tmp_path / "562.2.tsv").write_text(head.replace("Element symbol", "Gene symbol") + "\ngyrA_S83L\tn\tPOINT\tQ\tQ\tPOINTX\n")
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n3\t4\n")
    hits, files = readers.checked_hits(spark, str(tmp_path))
    assert sorted((r.genome_id, r["Element symbol"], r.Class) for r in hits.collect()) == [("562.10", "", "BETA"), ("562.10", "NA", "na"), ("562.10", "blaX", "BETA"), ("562.2", "gyrA_S83L", "Q")]
    assert sorted((r.genome_id, r.ok, r.rows) for r in files.collect()) == [("562.10", True, 4), ("562.2", True, 1), ("bad", False, 2)]


def test_small_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": ["x", "y"], "b": []}')
    (tmp_path / "s.tsv").write_text("genome_id\tsplit\tz\n562.10\ttrain\t1\n")
    assert sorted(map(tuple, readers.drug_targets(spark, str(tmp_path / "t.json")).collect())) == [("a", "x"), ("a", "y")]
    assert [tuple(r) for r in readers.split_table(spark, str(tmp_path / "s.tsv")).collect()] == [("562.10", "train")]
    ids = spark.createDataFrame([("b",), (" a ",), ("b",), ("",), (None,)], "genome_id string")
    assert [r[0] for r in readers.first_ids(ids, "genome_id").collect()] == ["a", "b"] and readers.first_ids(ids, "genome_id", 1).count() == 1
    long = spark.createDataFrame([("g", "f"), ("h", "f")], "genome string, feature string")
    writers.feature_store(long, long, str(tmp_path / "store"), "genome", "feature", ["feature"])
    back, axis = readers.feature_store(spark, str(tmp_path / "store"))
    assert sorted(back.collect()) == sorted(long.collect()) and [tuple(r) for r in axis.collect()] == [("f", 2)]


@pytest.mark.parametrize("k", [5, 8, 31, 32, 55, 56])
def test_md5_of_all_kmers_at_once(k):
    import hashlib

    s = bytes(np.random.default_rng(k).choice(list(b"ACGT"), 200).astype(np.uint8))
    want = [int(hashlib.md5(s[i : i + k]).hexdigest()[:16], 16) for i in range(201 - k)]
    assert similarity.kmer_md5(s, k).tolist() == want and len(similarity.kmer_md5(s[: k - 1], k)) == 0


def test_genome_signatures_against_brute_force(spark):
    import hashlib

    rng = random.Random(2)
    contigs = [(g, c, "".join(rng.choice("ACGTacgtN" if g != "n" else "N") for _ in range(rng.randint(3, 60)))) for g in ("a", "b", "n") for c in range(5)]
    seeds = [0, 12345, (1 << 59) + 7]
    want = {}
    for g in ("a", "b", "n"):
        seen, kmers = 0, set()
        for _, _, s in sorted(x for x in contigs if x[0] == g):
            if seen >= 60:
                break
            s = s.upper()
            seen += max(len(s) - 4, 0)
            kmers |= {s[i : i + 5] for i in range(len(s) - 4) if set(s[i : i + 5]) <= set("ACGT")}
        h = [int(hashlib.md5(k.encode()).hexdigest()[:15], 16) for k in kmers]
        want[g] = [min(x ^ t for x in h) for t in seeds] if h else None
    df = spark.createDataFrame(contigs, "genome string, contig int, seq string")
    got = similarity.genome_signatures(df, "genome", "contig", "seq", seeds, k=5, most=60)
    assert {r.genome: r.signature for r in got.collect()} == want


def test_genome_signatures_query_uses_whole_texts(spark, tmp_path):
    import hashlib

    from phenospark.functions import sequence as Q
    from phenospark.plans import extended

    rng = random.Random(5)
    text = "\n".join("".join(rng.choices("abcdefghij klm", k=n)) for n in (290_000, 400_000))
    spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "x string").select(Q.to_dna(F.col("x")).alias("s"))
    first, rest = ([int(hashlib.md5(s[i : i + 31].encode()).hexdigest()[:15], 16) for i in range(len(s) - 30)] for (s,) in lines.collect())
    minima = lambda h: [min(x ^ t for x in h) for t in (0, 1234567, 1 << 40)]
    got = {r.doc_id: r.signature for r in extended.genome_signatures(spark, str(tmp_path)).collect()}
    assert len(first) > 250_000 and minima(first) != minima(first + rest)
    assert got == {1: minima(first + rest), 2: None}


def test_texts_and_documents(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit, none = F.lit, F.array().cast("array<string>")
    assert one(S.gate_text(lit("not_callable"), F.array(lit("gyrA"), lit("parC")))) == "Not callable: no evidence for gyrA, parC."
    assert one(S.gate_text(lit("pass"), none)).startswith("All") and one(S.gate_text(lit("not_callable"), none)).endswith("good enough.")
    assert one(S.no_call_text(lit("conformal_band"), lit(0.5))).endswith("(P(fail)=0.500).") and one(S.no_call_text(lit("called"), lit(0.5))) is None
    assert one(S.node_label(lit("x" * 30), 10)) == "x" * 9 + "…" and one(S.node_label(lit(None).cast("string"))) == ""
    assert one(S.node_class(lit("done"), lit(S.FAIL))) == "fail" and one(S.node_class(lit("queued"), lit(S.FAIL))) == "pending"
    assert one(S.evidence_class(lit(False), lit(False), lit(S.WORK))) == "no_known_signal"
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    parents = spark.createDataFrame([("a", "Ann")], "pid string, name string")
    assert sorted((r.id, r.name) for r in store.with_parent(docs, parents, "p", "pid", ["name"]).collect()) == [(1, "Ann"), (2, None)]
    reports = spark.createDataFrame([(1, 5, "old"), (1, 9, "new")], "id int, at int, summary string")
    assert {r.id: (r.report and r.report.summary, r.n_reports) for r in store.attach(docs, reports, "id", "at").collect()} == {1: ("new", 2), 2: (None, 0)}
    assert [[x.at for x in r.history] for r in store.history(reports, "id", "at", ["summary"], 1).collect()] == [[9]]
    v = spark.createDataFrame([(1, "cip", S.WORK), (1, "amp", S.FAIL), (2, "cip", S.NO_CALL)], "id int, drug string, verdict string")
    got = {r.id: r.summary for r in store.stand_in_report(v, "id", "drug", "verdict").collect()}
    assert got == {1: "1 likely to fail, 1 likely to work, 0 without a call. May work: cip.", 2: "0 likely to fail, 0 likely to work, 1 without a call."}


@pytest.mark.parametrize("name", ["stratified_group_split", "stratified_folds_split"])
def test_split_queries_keep_their_promises(spark, name):
    """Every node once, no cluster in two splits, the largest held out, all splits there, the same again."""
    from phenospark.functions import constants as K
    from phenospark.plans import queries as plans

    df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    node, cluster, _ = df.columns
    got = [tuple(r) for r in df.collect()]
    assert len({n for n, _, _ in got}) == len(got) == plans.scored(spark, "/root/testdata/sf0.001").select("doc_id").distinct().count()
    of, size = {}, {}
    for _, c, s in got:
        assert of.setdefault(c, s) == s
        size[c] = size.get(c, 0) + 1
    held = sorted((size[c] for c, s in of.items() if s == "heldout_group"), reverse=True)
    assert held == sorted(size.values(), reverse=True)[: len(held)] and len(held) == min(K.HELDOUT_CLUSTERS, len(size))
    assert {"train", "calibration", "test", "heldout_group"} >= set(of.values()) >= {"train", "heldout_group"}
    assert sorted(got) == sorted(tuple(r) for r in plans.QUERIES[name](spark, "/root/testdata/sf0.001").collect())


def test_conflicts_against_brute_force(spark):
    """Groups of very different sizes, with nulls, ties and repeated rows."""
    rng = random.Random(9)
    rows = [(f"g{min(int(rng.expovariate(0.3)), 30)}", rng.choice([0, 1, None]), rng.choice([0, 1, None, None, None]), rng.choice([2020, 2021, None]), i, rng.choice(["A", "B", None])) for i in range(400)]
    rows += rows[:50]
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        has = any(r[2] is not None for r in own)
        pool = [(r[2] if has else r[1], *r[3:]) for r in own if (r[2] if has else r[1]) is not None]
        years = [y for _, y, _, _ in pool if y is not None]
        pool = [x for x in pool if not years or x[1] == max(years)]
        n1 = sum(x[0] for x in pool)
        if 2 * n1 != len(pool):
            label = int(2 * n1 > len(pool))
            _, y, _, std = min((x for x in pool if x[0] == label), key=lambda x: x[2])
            want[g] = (label, "rederived" if has else "submitted", std, y, len(own))
    df = spark.createDataFrame(rows, "g string, s int, r int, y int, p int, std string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in labels.resolve_conflicts(df, ["g"], "s", "r", "y", "p", "std").collect()}
    assert got == want and len(want) > 10
