"""Operators on small hand-computed cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.functions import constants as K
from phenospark.functions import normalize as N
from phenospark.functions import scoring as S
from phenospark.functions import sequence as Q
from phenospark.operators import evidence, features, gates, graph, labels, metrics, models, nocall, ordered, similarity, splits, store
from phenospark.plans import queries as plans
from phenospark.sources import readers, writers
from phenospark.streaming import counts

# ---------------------------------------------------------------- evidence: fixed cases
# symbol, subtype, class, subclass, method, drug -> confidence and tier, or None

GOLDEN = [
    ("gyrA_S83L", "POINT", "QUINOLONE", "QUINOLONE", "POINTX", "ciprofloxacin", ("confirmed", "point")),
    ("parC_E84V", "POINT", "QUINOLONE", "QUINOLONE", "POINTX", "ciprofloxacin", ("confirmed", "point")),
    ("gyrA_D87N", "POINT", "QUINOLONE", "QUINOLONE", "POINTX", "ciprofloxacin", ("confirmed", "point")),
    ("parE_I529L", "POINT", "QUINOLONE", "QUINOLONE", "POINTX", "ciprofloxacin", ("confirmed", "point")),
    ("blaTEM-1", "AMR", "BETA-LACTAM", "BETA-LACTAM", "ALLELEX", "cefotaxime", None),
    ("blaTEM-1", "AMR", "BETA-LACTAM", "BETA-LACTAM", "ALLELEX", "ampicillin", ("confirmed", "full_gene")),
    ("blaTEM-68", "AMR", "BETA-LACTAM", "CEPHALOSPORIN", "ALLELEX", "cefotaxime", ("confirmed", "full_gene")),
    ("blaCTX-M-15", "AMR", "BETA-LACTAM", "CEPHALOSPORIN", "ALLELEX", "cefotaxime", ("confirmed", "full_gene")),
    ("blaCTX-M-15", "AMR", "BETA-LACTAM", "CEPHALOSPORIN", "ALLELEX", "ceftazidime", ("confirmed", "full_gene")),
    ("blaCTX-M-15", "AMR", "BETA-LACTAM", "CEPHALOSPORIN", "ALLELEX", "meropenem", None),
    ("blaCTX-M-15", "AMR", "BETA-LACTAM", "CEPHALOSPORIN", "PARTIALX", "cefotaxime", ("confirmed", "degraded")),
    ("blaKPC-3", "AMR", "BETA-LACTAM", "CARBAPENEM", "ALLELEX", "meropenem", ("confirmed", "full_gene")),
    ("blaKPC-3", "AMR", "BETA-LACTAM", "CARBAPENEM", "ALLELEX", "cefotaxime", ("confirmed", "full_gene")),
    ("blaOXA-48", "AMR", "BETA-LACTAM", "CARBAPENEM", "ALLELEX", "meropenem", ("confirmed", "full_gene")),
    ("blaOXA-48", "AMR", "BETA-LACTAM", "CARBAPENEM", "ALLELEX", "cefotaxime", None),
    ("blaEC", "AMR", "BETA-LACTAM", "BETA-LACTAM", "BLASTX", "cefotaxime", None),
    ("blaEC-5", "AMR", "BETA-LACTAM", "CEPHALOSPORIN", "ALLELEX", "cefotaxime", None),
    ("blaEC", "AMR", "BETA-LACTAM", "BETA-LACTAM", "BLASTX", "ampicillin", None),
    ("ant(2'')-Ia", "AMR", "AMINOGLYCOSIDE", "GENTAMICIN/KANAMYCIN/TOBRAMYCIN", "EXACTX", "gentamicin", ("confirmed", "full_gene")),
    ("aac(3)-IIa", "AMR", "AMINOGLYCOSIDE", "GENTAMICIN", "EXACTX", "gentamicin", ("confirmed", "full_gene")),
    ("aac(6')-Ib", "AMR", "AMINOGLYCOSIDE", "AMIKACIN/KANAMYCIN/TOBRAMYCIN", "EXACTX", "gentamicin", None),
    ("rmtB", "AMR", "AMINOGLYCOSIDE", "AMINOGLYCOSIDE", "EXACTX", "gentamicin", ("confirmed", "full_gene")),
    ("aph(3')-IIa", "AMR", "AMINOGLYCOSIDE", "KANAMYCIN", "EXACTX", "gentamicin", ("review", "full_gene")),
    ("aadA5", "AMR", "AMINOGLYCOSIDE", "STREPTOMYCIN", "EXACTX", "gentamicin", None),
    ("qnrB19", "AMR", "QUINOLONE", "QUINOLONE", "EXACTX", "ciprofloxacin", ("confirmed", "full_gene")),
    ("aac(6')-Ib-cr", "AMR", "AMINOGLYCOSIDE/QUINOLONE", "AMIKACIN/KANAMYCIN/QUINOLONE/TOBRAMYCIN", "EXACTX", "ciprofloxacin", ("confirmed", "full_gene")),
    ("sul1", "AMR", "SULFONAMIDE", "SULFONAMIDE", "EXACTX", "sxt", ("confirmed", "full_gene")),
    ("dfrA17", "AMR", "TRIMETHOPRIM", "TRIMETHOPRIM", "EXACTX", "sxt", ("confirmed", "full_gene")),
    ("folP_F28L", "POINT", "SULFONAMIDE", "SULFONAMIDE", "POINTX", "trimethoprim-sulfamethoxazole", ("confirmed", "point")),
    ("sul2", "AMR", "SULFONAMIDE", "SULFONAMIDE", "INTERNAL_STOPX", "trimethoprim_sulfamethoxazole", ("confirmed", "degraded")),
]


def test_evidence_cases(spark):
    df = spark.createDataFrame([(i, *g[:6]) for i, g in enumerate(GOLDEN)], "i int, sym string, sub string, cls string, scl string, meth string, asked string")
    df = df.withColumn("want", evidence.resolve_drug(F.col("asked")))
    got = evidence.map_hits(df, evidence.rule_rows(), "sym", "sub", "cls", "scl").withColumn("tier", N.tier(F.col("sub"), F.col("meth")))
    rows = {(r.i, r.drug): r for r in got.collect()}
    asked = {r.i: r.want for r in df.collect()}
    for i, g in enumerate(GOLDEN):
        r = rows.get((i, asked[i]))
        assert (r and (r.confidence, r.tier)) == g[6], g
    part = {r.sym: r.component for r in got.filter("asked = 'sxt'").collect()}
    assert part["sul1"] == "sulfamethoxazole" and part["dfrA17"] == "trimethoprim"
    assert len(evidence.rule_rows()) == 30


# ---------------------------------------------------------------- metrics: fixed cases

Y, P = [0, 0, 1, 1, 0, 1], [0.2, 0.7, 0.4, 0.8, 0.3, 0.6]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([("d", i, y, p) for i, (y, p) in enumerate(zip(Y, P))], "drug string, i int, y int, p double")


def test_metrics_toy(toy):
    m = metrics.confusion(toy, ["drug"]).first()
    assert m.recall_resistant == pytest.approx(2 / 3) and m.balanced_accuracy == pytest.approx(2 / 3) and m.f1 == pytest.approx(4 / 6) and m.brier == pytest.approx(1.18 / 6)
    assert metrics.auroc(toy, ["drug"]).first().auroc == pytest.approx(7 / 9)
    assert metrics.average_precision(toy, ["drug"]).first().average_precision == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)


def test_one_class_is_undefined(spark):
    one = spark.createDataFrame([("d", 1, 0.3), ("d", 1, 0.9)], "drug string, y int, p double")
    m = metrics.confusion(one, ["drug"]).first()
    assert m.recall_susceptible is None and m.balanced_accuracy is None and m.f1 is None and m.recall_resistant == 0.5
    assert metrics.auroc(one, ["drug"]).first().auroc is None


def test_reliability_centres(spark):
    df = spark.createDataFrame([(i % 2, 0.05 + 0.1 * i) for i in range(10)] + [(1, 1.0), (0, 0.3)], "y int, p double")
    got = {r.bin: r.n for r in metrics.reliability(df, []).collect()}
    edges = np.linspace(0, 1, 11)
    want = np.clip(np.digitize([0.05 + 0.1 * i for i in range(10)] + [1.0, 0.3], edges) - 1, 0, 9)
    assert got == {b: int((want == b).sum()) for b in range(10)}


def test_risk_coverage(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.9), (2, 1, 0.4), (3, 0, 0.6)], "i int, y int, p double")
    r = {x.point: x for x in metrics.risk_coverage(df, "i").collect()}
    assert r[0].coverage == 1.0 and r[0].accuracy == 0.5 and r[19].coverage == 0.25 and r[19].accuracy == 1.0 and r[19].balanced_accuracy is None


def test_bootstrap_is_repeatable_and_bounded(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(i % 20, rng.randint(0, 1), rng.random()) for i in range(400)], "c int, y int, p double")
    a = metrics.bootstrap_ci(df, "c")
    assert a == metrics.bootstrap_ci(df, "c") and 0 <= a[0] <= a[1] <= 1
    assert metrics.bootstrap_ci(df.filter("c = 0"), "c") is None


# ---------------------------------------------------------------- abstention: fixed cases


def test_conformal_toy(spark):
    rows = [(0, float(x)) for x in np.linspace(0.01, 0.20, 20)] + [(1, float(x)) for x in np.linspace(0.80, 0.99, 20)]
    cal = spark.createDataFrame(rows, "y int, p double")
    b = nocall.conformal_bands(cal, [], alpha_s=0.02, alpha_r=0.10).first()
    assert (b.q_s, b.q_r, b.low, b.high) == pytest.approx((0.20, 0.19, 0.20, 0.81))
    got = spark.createDataFrame([(p,) for p in (0.05, 0.20, 0.50, 0.75, 0.81, 0.90)], "p double").select(nocall.no_call(F.col("p"), F.lit(0.20), F.lit(0.19 + 1e-12)).alias("m"))
    assert [r.m for r in got.collect()] == [False, False, True, True, False, False]


def test_distance_quantile(spark):
    d = spark.createDataFrame([(float(i),) for i in range(1, 101)], "d double")
    assert nocall.distance_threshold(d, "d", 0.9).first().quantile == pytest.approx(90.1)


def test_distance_without_threshold_fails(spark):
    with pytest.raises(Exception, match="threshold"):
        spark.range(1).select(nocall.no_call(F.lit(0.1), F.lit(0.2), F.lit(0.1), F.lit(3.0), F.lit(None).cast("double")).alias("m")).collect()


def test_gate_override_toy(spark):
    p, base = [0.05, 0.10, 0.15, 0.90, 0.50], [False, False, False, False, True]
    status = ["pass", "not_callable", "absence_of_evidence", "not_callable", "not_callable"]
    df = spark.createDataFrame(list(zip(p, base, status)), "p double, m boolean, s string")
    got = df.select(nocall.gate_override(F.col("p"), F.lit(0.2), F.lit(0.19), F.col("m"), F.col("s")).alias("x")).select("x.*").collect()
    assert [r.mask for r in got] == [False, True, False, False, True] and sum(r.flipped for r in got) == 1


# ---------------------------------------------------------------- clusters and splits: fixed cases

EDGES = [
    ("g1", "g2", 99.8, 95.0, 96.0), ("g2", "g3", 99.7, 88.0, 90.0), ("g3", "g4", 99.9, 92.0, 91.0), ("g5", "g6", 99.9, 90.0, 90.0), ("g6", "g7", 99.6, 85.0, 87.0),
    ("g8", "g9", 99.8, 90.0, 90.0), ("g10", "g11", 99.9, 90.0, 90.0), ("g4", "g5", 99.9, 70.0, 90.0), ("g8", "g10", 98.0, 95.0, 95.0),
]


@pytest.fixture(scope="module")
def clusters(spark):
    e = spark.createDataFrame(EDGES, "ref string, query string, ani double, af_ref double, af_query double")
    nodes = spark.createDataFrame([(f"g{i}",) for i in range(1, 14)], "g string")
    strong = similarity.strong_edges(e, "ref", "query", "ani", "af_ref", "af_query")
    return e, graph.dense_cluster_ids(graph.connected_components(strong, "ref", "query", nodes, "g"))


def test_cluster_gates(clusters):
    _, c = clusters
    of = {r.node: r.cluster_id for r in c.collect()}
    assert sorted(np.bincount(list(of.values()))) == [1, 1, 2, 2, 3, 4] and set(of.values()) == set(range(6))
    assert of["g4"] != of["g5"] and of["g8"] != of["g10"] and of["g1"] == of["g4"]


def test_splits_keep_clusters_whole_and_audit_finds_a_clone(spark, clusters):
    e, c = clusters
    y = spark.createDataFrame([(f"g{i + 1}", i % 2) for i in range(13)], "node string, y int")
    s = splits.assign_splits(c.select("node", "cluster_id"), "node", "cluster_id", y, n_heldout=2)
    again = splits.assign_splits(c.select("node", "cluster_id"), "node", "cluster_id", y, n_heldout=2)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect())) and s.count() == 13
    held = {r.node for r in s.filter("split = 'heldout_group'").collect()}
    assert held == {"g1", "g2", "g3", "g4", "g5", "g6", "g7"}
    clean = splits.leakage_audit(e, s, "ref", "query", "ani", "node", "cluster_id", "split", 99.5).first()
    assert clean.spanning_clusters == 0
    planted = s.withColumn("split", F.when(F.col("node") == "g1", "train").otherwise(F.col("split")))
    bad = splits.leakage_audit(e, planted, "ref", "query", "ani", "node", "cluster_id", "split", 99.5).first()
    assert bad.spanning_clusters == 1 and bad.max_train_heldout == 99.8 and bad.violations >= 1


def test_shared_features(spark):
    long = spark.createDataFrame([("g1", "blaTEM"), ("g1", "blaCTX-M"), ("g8", "blaCTX-M"), ("g8", "blaKPC")], "g string, f string")
    where = spark.createDataFrame([("g1", "train"), ("g8", "heldout_group")], "g string, s string")
    r = splits.shared_features(long, where, "g", "f", "s", F.col("s") == "train", F.col("s") == "heldout_group").first()
    assert (r.n_both, r.n_any, r.jaccard) == (1, 3, pytest.approx(1 / 3))


def test_nearest_train(spark):
    e = spark.createDataFrame([("a", "a", 100.0), ("a", "b", 99.0), ("b", "c", 98.0), ("d", "e", 97.0)], "x string, y string, ani double")
    nodes = spark.createDataFrame([(v,) for v in "abcde"], "g string")
    got = {r.node: r.distance for r in similarity.nearest_in_train(e, nodes.filter("g in ('a', 'b')"), nodes, "x", "y", "ani", "g").collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 2.0, "d": 100.0, "e": 100.0}


def test_average_linkage():
    x = np.array([0.0, 0.01, 0.02, 1.0, 1.01])
    assert similarity.average_linkage(np.abs(x[:, None] - x), 0.05).tolist() == [0, 0, 0, 1, 1]


def test_cosine_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.5}
    for block in (7, 1000):
        assert {(r.a, r.b) for r in similarity.cosine_edges(df, "id", "v", 0.5, block).collect()} == want


# ---------------------------------------------------------------- labels


@pytest.mark.parametrize(
    "sign,value,want",
    [(">", 0.4, None), (">", 0.5, 1), (">=", 0.5, 1), ("<", 0.25, 0), ("<=", 0.3, None), ("=", 0.25, 0), ("=", 0.3, None), ("=", 0.5, None), ("=", 0.51, 1)],
)
def test_censored_call(spark, sign, value, want):
    assert spark.range(1).select(N.censored_call(F.lit(value), F.lit(sign), F.lit(0.25), F.lit(0.5)).alias("c")).first().c == want


def test_null_breakpoint(spark):
    assert spark.range(1).select(N.censored_call(F.lit(1.0), F.lit("="), F.lit(None).cast("double"), F.lit(0.5)).alias("c")).first().c is None


@pytest.mark.parametrize("m,want", [("<=2", (2.0, "<=")), (" > 0.5 ", (0.5, ">")), ("4", (4.0, "=")), ("x4", None), ("", None), (None, None)])
def test_measurement(spark, m, want):
    r = spark.range(1).select(N.mic(F.lit(""), F.lit(""), F.lit(m).cast("string")).alias("x")).first().x
    assert (r and (r.value, r.sign)) == want


def test_own_value_wins_and_odd_sign_is_exact(spark):
    r = spark.range(1).select(N.mic(F.lit("8 mg"), F.lit("~"), F.lit("<=2")).alias("x")).first().x
    assert (r.value, r.sign) == (8.0, "=")


def test_conflicts(spark):
    rows = [
        ("a", "x", 1, None, 2001, 0, "S1"), ("a", "x", 0, None, 2005, 1, "S2"),  # the later year counts
        ("b", "x", 1, None, None, 2, ""), ("b", "x", 0, None, None, 3, ""),  # a tie
        ("c", "x", 0, 1, None, 4, "S3"), ("c", "x", 0, None, None, 5, "S4"),  # derived anew comes first
        ("d", "x", None, None, 2000, 6, ""),  # nothing to count
        ("e", "x", 1, None, 2000, 7, "S5"), ("e", "x", 1, None, 2000, 8, "S6"), ("e", "x", 0, None, 2000, 9, "S7"),
    ]
    df = spark.createDataFrame(rows, "g string, d string, s int, r int, y int, p int, std string")
    got = {r.g: r for r in labels.resolve_conflicts(df, ["g", "d"], "s", "r", "y", "p", "std").collect()}
    assert set(got) == {"a", "c", "e"}
    assert (got["a"].label, got["a"].testing_standard, got["a"].testing_standard_year, got["a"].n_source_rows) == (0, "S2", 2005, 2)
    assert (got["c"].label, got["c"].label_source, got["c"].testing_standard, got["c"].n_source_rows) == (1, "rederived", "S3", 2)
    assert (got["e"].label, got["e"].label_source, got["e"].testing_standard) == (1, "submitted", "S5")


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(N.drug_bucket(F.lit(" Cipro Â\t floxacin "))) in ("cipro floxacin", "cipro  floxacin")
    assert one(N.standard(F.lit("eucast v11 / CLSI"))) == "EUCAST+CLSI" and one(N.standard(F.lit(" NARMS "))) == "NARMS"
    assert one(N.year(F.lit("M100 2019 ed"))) == 2019 and one(N.year(F.lit(None).cast("string"))) is None
    assert one(N.loose_phenotype(F.lit("Nonsusceptible"))) is None and one(N.loose_phenotype(F.lit("sus"))) == "susceptible"
    assert one(N.identifier(F.lit(" 562.144150 "))) == "562.144150" and one(N.method_base(F.lit("xX"))) == "XX"
    assert one(S.marker_label(F.lit("blaX"), F.lit("BLAX"), F.lit("C"))) == "blaX [C]" and one(S.marker_label(F.lit(""), F.lit(None).cast("string"), F.lit("C"))) is None
    assert len(K.canonical_names()) > 80


# ---------------------------------------------------------------- sequences and gates


def test_sequence_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(Q.reverse_complement(F.lit("AACGTN"))) == "NACGTT" and one(Q.locus(F.lit("ABCDE"), F.lit(2), F.lit(4))) == "BCD"
    assert one(Q.kmers(F.lit("AB"), 3)) == [] and one(Q.kmers(F.lit("ABAB"), 2)) == ["AB", "BA"] and one(Q.clean_kmers(F.lit("acgnt"), 2)) == ["AC", "CG"]
    assert one(Q.gc_percent(F.lit("GCAT-N"))) == 50.0 and one(Q.format_bases(F.lit(4_600_000))) == "4.60 Mbp" and one(Q.gc_percent(F.lit(""))) is None
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(2000))
    step = max(1, (2000 - 31) // 48)
    assert set(one(Q.spaced_kmers(F.lit(seq)))) == {seq[i : i + 31] for i in range(0, 2000 - 30, step)}
    assert one(Q.mash_distance(F.lit(0.0), 21)) == 1.0 and one(Q.mash_distance(F.lit(1.0), 21)) == 0.0
    assert one(Q.token_hash(F.lit(b"abc"))) == 648541476951500027
    seeds = [3, 99, 12345]
    h = [one(Q.token_hash(F.lit(x.encode()))) for x in ("a", "b", "c")]
    assert one(Q.minhash(F.array(F.lit("a"), F.lit("b"), F.lit("c")), seeds)) == [min(x ^ s for x in h) for s in seeds]


def test_gates(spark):
    rng = random.Random(7)
    seq = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    loci, filler = {x: seq(2000) for x in ("gyrA", "parC")}, seq(10_000)
    donor = filler[:1000] + loci["gyrA"] + filler[3000:4000] + loci["parC"] + filler[6000:]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    contigs = spark.createDataFrame([("donor", "c1", donor), ("whole", "c1", rc(donor)), ("half", "c1", filler[:1000] + loci["gyrA"]), ("none", "c1", seq(5000))], "genome string, contig string, seq string")
    where = spark.createDataFrame([("gyrA", "c1", 1001, 3000), ("parC", "c1", 4001, 6000)], "locus string, contig string, start int, stop int")
    ref = gates.reference_kmers(contigs.filter("genome = 'donor'"), where)
    share = gates.kmer_share(contigs, "genome", ref)
    got = {(r.genome, r.locus): r.share for r in share.collect()}
    assert got["whole", "gyrA"] == 1.0 and got["whole", "parC"] == 1.0 and got["half", "gyrA"] == 1.0 and got["half", "parC"] == 0.0 and got["none", "gyrA"] == 0.0
    hits = spark.createDataFrame([("none", "gyrA_S83L", "GyrA", "POINT"), ("none", "parC_S80S", "ParC [WILDTYPE]", "POINT"), ("half", "gyrA_S83L", "GyrA [UNKNOWN]", "POINT_DISRUPT")], "genome string, sym string, name string, sub string")
    ev = gates.locus_evidence(hits, "genome", "sym", "name", "sub", ["gyrA", "parC"])
    screened = spark.createDataFrame([("half",), ("none",)], "genome string")
    status = {r.genome: (r.status, r.missing) for r in gates.gate_status(contigs.select("genome"), "genome", ["gyrA", "parC"], ev, screened, share).collect()}
    assert status == {"donor": ("pass", []), "whole": ("pass", []), "half": ("not_callable", ["parC"]), "none": ("pass", [])}
    qc = gates.assembly_qc(contigs, "genome", F.length("seq"), 4000, 11_000, 1)
    assert {r.genome: r.ok for r in qc.collect()} == {"donor": True, "whole": True, "half": False, "none": True}
    assert {r.status for r in gates.gate_without_loci(qc, "genome").collect()} == {"absence_of_evidence", "not_callable"}
    frame = contigs.select("genome").distinct().crossJoin(spark.createDataFrame([("gyrA",), ("parC",)], "locus string"))
    call = {(r.genome, r.locus): r.status for r in gates.callability(frame, ev, share, "genome").collect()}
    assert call["none", "gyrA"] == "mutation_present" and call["whole", "parC"] == "wild_type_intact" and call["half", "parC"] == "not_called"


# ---------------------------------------------------------------- ordered, features, store, models


def test_prefix_sums_against_numpy(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {(r.g, r.i): r.s for r in ordered.prefix_sums(df, [F.col("i")], {"s": F.col("v")}, ["g"]).collect()}
    run = {"a": 0, "b": 0}
    for g, i, v in rows:
        run[g] += v
        assert got[g, i] == run[g]


def test_quantiles_against_numpy(spark):
    rng = random.Random(4)
    v = [float(rng.randint(0, 30)) for _ in range(101)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        assert ordered.linear_quantile(df, "v", q).first().quantile == pytest.approx(float(np.quantile(v, q)))


def test_features(spark):
    long = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "f3"), ("b", "f9")], "e string, f string")
    wide = features.presence_pivot(long, "e", "f", ["f1", "f2", "f3", "f4"]).orderBy("e").collect()
    assert [tuple(r) for r in wide] == [("a", 1, 1, 0, 0), ("b", 0, 0, 1, 0)]
    assert {r.e: r.indices for r in features.sparse_vectors(long, "e", "f", ["f1", "f2", "f3"]).collect()} == {"a": [0, 1], "b": [2]}


def test_store(spark):
    base = spark.createDataFrame([(1, "n", "1990"), (2, "m", None)], "k int, name string, dob string")
    delta = spark.createDataFrame([(1, "N", None), (3, "new", None)], "k int, name string, dob string")
    assert sorted(map(tuple, store.upsert(base, delta, "k").collect())) == [(1, "N", "1990"), (2, "m", None), (3, "new", None)]
    ev = spark.createDataFrame([(1, 5, "processing"), (1, 9, "complete"), (2, 3, "failed")], "k int, ts int, s string")
    assert {r.k: r.s for r in store.latest(ev, "k", [F.col("ts")], ["s"]).collect()} == {1: "complete", 2: "failed"}
    kids = spark.createDataFrame([(1, 10, "x"), (1, 20, "y")], "p int, ts int, c string")
    t = {r.k: [tuple(x) for x in r.children] for r in store.tree(base, kids, "k", "p", "c", "ts").collect()}
    assert t == {1: [(20, "y"), (10, "x")], 2: []}
    people = spark.createDataFrame([("P-12", "Ann Lee"), ("P-3", "Bo Ann"), ("Q-12", "Cy")], "id string, name string")
    assert {r.id for r in store.search(people, " 12 ", "name", "id").collect()} == {"P-12", "Q-12"}
    assert {r.id for r in store.search(people, "ann", "name", "id").collect()} == {"P-12", "P-3"} and store.search(people, "  ", "name", "id").count() == 0


def test_oversample_and_folds(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(50)], "i int, y int")
    n = {r.y: r["count"] for r in splits.oversample(df, "y").groupBy("y").count().collect()}
    assert n == {0: 40, 1: 40}
    g = splits.group_folds(df.withColumn("g", F.col("i") % 7), "g")
    assert g.select("g", "fold").distinct().count() == 7


def test_platt_keeps_order_and_models_learn(spark):
    rng = random.Random(5)
    rows = [(y, min(0.99, max(0.01, rng.gauss(0.35 + 0.3 * y, 0.15))), rng.random()) for y in (0, 1) for _ in range(150)]
    df = spark.createDataFrame([(i, y, p, x) for i, (y, p, x) in enumerate(rows)], "i int, y int, p double, x double")
    slope, intercept = models.platt(df, "p", "y")
    assert slope > 0 and math.isfinite(intercept)
    cal = models.calibrate(df, df, "p", "y").select("p", "p_calibrated").orderBy("p").collect()
    assert all(a.p_calibrated <= b.p_calibrated + 1e-12 for a, b in zip(cal, cal[1:]))
    net = models.elastic_net(df, ["p", "x"], "y")
    scored = models.probability(net, df.select("i", "y", "x", F.col("p")), "q").select("y", F.col("q").alias("p"))
    assert metrics.auroc(scored, []).first().auroc > 0.85
    w = writers.model_json(net)
    assert w["features"] == ["p", "x"] and w["coefficients"][0] > 0


# ---------------------------------------------------------------- sources and sinks


def test_sources(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("Genome ID,Antibiotic,Measurement\n562.144150,cipro,<=2\n562.1,,\n")
    df, missing = readers.backfill(readers.text_table(spark, str(tmp_path / "raw.csv")), ["Genome ID", "Evidence"])
    assert missing == ["Evidence"] and [tuple(r) for r in df.collect()] == [("562.144150", "cipro", "<=2", ""), ("562.1", "", "", "")]
    head = "Contig id\tElement symbol\tElement name\tSubtype\tClass\tSubclass\tMethod\n"
    (tmp_path / "562.100171.tsv").write_text(head + "c\tgyrA_S83L\tn\tPOINT\tQ\tQ\tPOINTX\n")
    hits = readers.annotation_hits(spark, str(tmp_path / "*.tsv"))
    assert [(r.genome_id, r["Element symbol"]) for r in hits.collect()] == [("562.100171", "gyrA_S83L")]
    (tmp_path / "bad.txt").write_text("a\tb\n1\t2\n")
    with pytest.raises(readers.MissingColumns):
        readers.annotation_hits(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "562.5.fna").write_text(">c1 first contig\nACGT\nacgtnn\n>c2\nGG\r\nCC\n")
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "*.fna")).collect())) == [("562.5", "c1", "ACGTACGTNN"), ("562.5", "c2", "GGCC")]
    (tmp_path / "ani.tsv").write_text("Ref_file\tQuery_file\tANI\tAlign_fraction_ref\tAlign_fraction_query\n/x/562.1.fna\t/y/562.2.fna\t99.5\t90\t80.5\n")
    assert [tuple(r) for r in readers.ani_edges(spark, str(tmp_path / "ani.tsv")).collect()] == [("562.1", "562.2", 99.5, 90.0, 80.5)]
    (tmp_path / "splits.json").write_text('{"g1": {"cluster_id": 3, "split": "train"}, "g2": {"cluster_id": 4, "split": "test"}}')
    assert sorted(map(tuple, readers.json_map(spark, str(tmp_path / "splits.json"), "struct<cluster_id:int,split:string>").collect())) == [("g1", 3, "train"), ("g2", 4, "test")]
    (tmp_path / "list.txt").write_text("# ids\n562.1\n\n 562.2 \n")
    assert sorted(r.value for r in readers.line_list(spark, str(tmp_path / "list.txt")).collect()) == ["562.1", "562.2"]
    (tmp_path / "labels.tsv").write_text("genome_id\tantibiotic\tphenotype\tlabel\ng\ta\tR\tlikely_to_fail\nh\ta\tS\tlikely_to_work\n")
    assert {r.genome_id: r.y for r in readers.label_table(spark, str(tmp_path / "labels.tsv")).collect()} == {"g": 1, "h": 0}
    (tmp_path / "bp.yaml").write_text("ecoli:\n  cip: {s_max_mg_l: 0.25, r_min_mg_l: 0.5}\n  gen: {s_max_mg_l: null, r_min_mg_l: 2}\nother: {}\n")
    assert [tuple(r) for r in readers.breakpoint_table(spark, readers.yaml_config(str(tmp_path / "bp.yaml"))).collect()] == [("ecoli", "cip", 0.25, 0.5)]
    seq = spark.createDataFrame([(">a\nACGTACGTACGTACGTACGTNN\n>b\nAC-GT\n",), ("no header ACGT",)], "t string").select(readers.fasta_summary(F.col("t")).alias("x")).collect()
    assert (seq[0].x.records, seq[0].x.bases, seq[0].x.ok) == (2, 24, True) and not seq[1].x.ok


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g2", 0.25, True, "ani_ood", 3.0), ("g1", 0.1234567, False, "called", 0.5)], "genome_id string, p double, no_call boolean, reason string, distance double")
    lines = [r.value for r in writers.probability_lines(df, "v3", "genome_id").collect()]
    assert lines == ["# version=v3", "genome_id,p,no_call,reason,dist_to_train", "g1,0.123457,0,called,0.50", "g2,0.250000,1,ani_ood,3.00"]
    writers.sorted_csv(df, str(tmp_path / "out"), ["genome_id"])
    assert [r.genome_id for r in readers.text_table(spark, str(tmp_path / "out")).orderBy("genome_id").collect()] == ["g1", "g2"]
    doc = writers.as_json_map(df, "genome_id", ["reason"]).first().value
    assert doc == '{"g1":{"reason":"called"},"g2":{"reason":"ani_ood"}}'
    m = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "k string, v double")
    assert {r.value for r in writers.metrics_json(m).collect()} == {'{"k":"a","v":null}', '{"k":"b","v":1.0}'}
    assert "| g1 |" in writers.markdown_report("t", [("s", df.select("genome_id"))])
    writers.feature_store(df.select("genome_id", F.col("reason").alias("f")), df, str(tmp_path / "fs"), "genome_id", "f", ["reason"])
    assert spark.read.parquet(str(tmp_path / "fs/axis")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"A/B{i % 2}",) for i in range(10)] + [("NA",), (None,)], "c string").write.parquet(str(tmp_path / f"in/{k}"))
    batch = spark.read.parquet(str(tmp_path / "in/*"))
    stream = counts.stream_folder(spark, str(tmp_path / "in/*"), batch.schema, files=1)
    want = {(r.cls, r.n) for r in counts.class_counts(batch, F.col("c")).collect()}
    assert {(r.cls, r.n) for r in counts.run_available(counts.class_counts(stream, F.col("c")), "t").collect()} == want == {("A", 30), ("B0", 15), ("B1", 15)}


# ---------------------------------------------------------------- whole jobs


def test_callability_of_every_item_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    docs = [(i, texts[i][: 40 + 20 * i] + " " + texts[(i + 3) % 12][100:]) for i in range(12)]
    items = [(i, t) for i, t in enumerate(texts)] + [(12, "too short"), (13, texts[9][:80])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    dna = lambda t: "".join("ACGT"[(ord(c) - 97) % 4] for c in t if c.isalpha())
    rc = lambda s: s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    want = {}
    for item, t in items:
        s = dna(t)
        probes = {s[i : i + 31] for i in range(0, len(s) - 30, max(1, (len(s) - 31) // 48))}
        for doc, u in docs:
            if probes:
                u = dna(u)
                want[doc, str(item)] = max(sum(p in u for p in probes), sum(rc(p) in u for p in probes)) / len(probes)
    got = {(r.doc_id, r.locus): r.share for r in plans.kmer_callability_all(spark, str(tmp_path)).collect()}
    assert len({k[1] for k in want}) == 13 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_kmer_share_goes_through_the_panel_in_blocks(spark):
    rng = random.Random(3)
    seqs = {f"l{i}": "".join(rng.choice("ACGT") for _ in range(500)) for i in range(6)}
    contigs = spark.createDataFrame([(k, k, s) for k, s in seqs.items()], "genome string, contig string, seq string")
    where = spark.createDataFrame([(k, k, 1, 500) for k in seqs], "locus string, contig string, start int, stop int")
    ref = gates.reference_kmers(contigs.select("contig", "seq"), where)
    got = {(r.genome, r.locus): r.share for r in gates.kmer_share(contigs, "genome", ref, most=150).collect()}
    assert got == {(g, x): float(g == x) for g in seqs for x in seqs}


def test_a_panel_of_many_probes_is_one_scan_and_long_sequences_are_cut(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    items = {f"l{i}": some(80) for i in range(500)}
    ref = spark.createDataFrame([(x, "fwd", s[j : j + 31]) for x, s in items.items() for j in range(50)], "locus string, strand string, kmer string")
    seqs = ["N".join([items["l3"], some(500), items["l4"][:60], "acgt", items["l3"]]), "", None, some(31), items["l5"][:31]]
    wide = spark.createDataFrame(list(enumerate(seqs)), "genome long, seq string")
    got = gates.kmer_share(wide, "genome", ref)  # 25,000 probes; before, two scans of the sequences
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r.genome, r.locus): r.share for r in got.collect()}
    assert len(got) == 5 * 500 and {k: v for k, v in got.items() if v} == {(0, "l3"): 1.0, (0, "l4"): 0.6, (4, "l5"): 0.02}
    raw = [None if s is None else s.encode() for s in seqs]
    kmers = [seqs[0][i : i + 31] for i in range(0, 50, 3)] * 2 + ["A" * 31]
    for most in (7, 100, 1 << 18):
        monkeypatch.setattr(gates, "SLICE", most)
        assert max(len(x) for _, part in gates._slices(raw, 31, most) for x in part) <= most + 30
        row, hit = gates.Probes(kmers, 31).find(raw)
        assert set(zip(row.tolist(), hit.tolist())) == {(0, j) for j in range(len(kmers) - 1)}


def test_rows_for_each_genome_and_locus_are_made_by_many_tasks(spark):
    ref = spark.createDataFrame([(f"l{i}", "fwd", "ACGT" * 7 + f"{i:03d}".translate(str.maketrans("0123456789", "ACGTACGTAC"))) for i in range(20)], "locus string, strand string, kmer string")
    genomes = spark.range(2000).select(F.col("id").alias("genome"), F.lit("ACGT").alias("seq"))
    per = gates.kmer_share(genomes, "genome", ref).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 40_000 and max(r["count"] for r in per) < 20_000  # before, all in one task


def test_out_of_fold_returns_every_row_once(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, i % 2, f"s{i % 23}", rng.random() + 0.3 * (i % 2)) for i in range(230)], "i int, y int, g string, x double")
    r = splits.group_folds(df, "g")
    assert r.select("fold").distinct().count() == splits.FOLDS
    got = [x.i for x in models.out_of_fold(r, ["x"], "y").select("i").collect()]
    assert sorted(got) == list(range(230))
    with pytest.raises(ValueError):
        models.out_of_fold(r, ["x"], "y", k=3)
    with pytest.raises(ValueError):
        models.out_of_fold(df.withColumn("fold", F.col("y")), ["x"], "y")


def test_threshold_counts_every_labelled_row(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    docs = [(i, "en" if i % 3 else "de", f"s{i % 23}", rng.randint(50, 5000)) for i in range(230)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, rng.randint(0, 1), 0) for i in range(230)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    monkeypatch.setattr(models, "best_threshold", lambda oof, p, y: seen.extend(r.doc_id for r in oof.select("doc_id").collect()) or 0.5)
    assert plans.grouped_cv_threshold(spark, str(tmp_path)).first().tau == 0.5
    assert sorted(seen) == list(range(230))


def test_linkage_of_vectors_and_pairs_equals_the_matrix(spark):
    rng = np.random.default_rng(8)
    for n, cut in ((40, 0.3), (90, 0.62), (60, 0.9), (1, 0.5)):
        x = rng.normal(size=(n, 6)) + 2 * rng.normal(size=(5, 6))[rng.integers(0, 5, n)]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
        assert same_parts(similarity.vector_average_linkage(x.copy(), cut), similarity.average_linkage(d, cut))
        i, j = np.nonzero(np.triu(d < 0.8, 1))
        far = np.ones_like(d)
        far[i, j] = far[j, i] = d[i, j]
        assert same_parts(similarity.sparse_average_linkage(n, i, j, d[i, j], cut), similarity.average_linkage(far, cut))
    names = [(int(a), int(b), float(d[a, b])) for a, b in zip(i, j)] or [(0, 1, 0.2), (1, 2, 0.9)]
    pairs = spark.createDataFrame([("g", *p) for p in names], "g string, a int, b int, distance double")
    by = lambda **k: {r.node: r.cluster for r in similarity.linkage_clusters(pairs, "g", "a", "b", "distance", 0.62, **k).collect()}
    assert by() == by(largest=2)


def test_kmers_make_their_sequence_once(spark):
    plan = lambda c: spark.range(1).select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    text = F.concat(F.col("id").cast("string"), F.lit("the quick brown fox jumps over the lazy dog again"))
    for found in (Q.spaced_kmers(Q.to_dna(text)), Q.kmers(Q.to_dna(text), 5), Q.clean_kmers(Q.to_dna(text), 5)):
        assert plan(found).count("regexp_replace") == 1
    none = F.when(F.col("id") > 5, "x")
    assert [spark.range(1).select(c).first()[0] for c in (Q.kmers(none, 5), Q.spaced_kmers(none))] == [[], []]


def same_parts(one, two) -> bool:
    return len(set(zip(one.tolist(), two.tolist()))) == len(set(one.tolist())) == len(set(two.tolist()))


def test_linkage_query_gives_every_embedding_the_cluster_of_the_whole_matrix(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(50, 8)) + 3 * rng.normal(size=(4, 8))[rng.integers(0, 4, 50)], 9 * np.eye(8)[:3] * -1])
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.node: (r.root, r.cluster) for r in plans.linkage_clusters(spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = similarity.average_linkage(1 - u @ u.T, 0.62)
    assert sorted(got) == list(range(53))
    assert len(set(zip(want.tolist(), (got[i] for i in range(53))))) == len(set(want.tolist())) == len(set(got.values()))


def test_forest_query_grows_the_operators_trees(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    spark.createDataFrame([(i, "en", f"s{i % 23}", rng.randint(50, 5000)) for i in range(230)], "doc_id long, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, rng.randint(0, 1), 0) for i in range(230)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    grown = []
    real = models.probability
    monkeypatch.setattr(models, "probability", lambda m, *rest: grown.append(m.stages[-1].getNumTrees) or real(m, *rest))
    assert plans.random_forest(spark, str(tmp_path)).count() == 230
    assert grown == [300]
