"""Evaluation of probabilities against labels, grouped by any columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import prefix_sums

#: Ten equal bins; written out, as computed edges differ in the last bit.
BIN_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def confusion(df: DataFrame, by: list[str], y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Counts, recalls, balanced accuracy, F1 and Brier score in one aggregate; null where undefined."""
    yes, hit = F.col(y) == 1, F.col(p) >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n(yes).alias("n_resistant"), n(F.col(y) == 0).alias("n_susceptible"), n(yes & hit).alias("tp"), n(~yes & hit).alias("fp"), n(~yes & ~hit).alias("tn"),
        F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"),
    )
    g = g.withColumn("recall_resistant", F.try_divide("tp", "n_resistant")).withColumn("recall_susceptible", F.try_divide("tn", "n_susceptible"))
    both = (F.col("n_resistant") > 0) & (F.col("n_susceptible") > 0)
    g = g.withColumn("balanced_accuracy", (F.col("recall_resistant") + F.col("recall_susceptible")) / 2)
    fn = F.col("n_resistant") - F.col("tp")
    g = g.withColumn("f1", F.when(both, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + fn)))
    return g.select(*by, "n", "n_resistant", "n_susceptible", "recall_resistant", "recall_susceptible", "balanced_accuracy", "f1", "brier")


def _ranked(df: DataFrame, by: list[str], y: str, p: str, descending: bool) -> DataFrame:
    per = df.groupBy(*by, F.col(p).alias("p")).agg(F.sum(y).cast("long").alias("pos"), F.count(F.lit(1)).alias("cnt"))
    order = F.col("p").desc() if descending else F.col("p").asc()
    return prefix_sums(per, [order], {"cum_pos": F.col("pos"), "cum_n": F.col("cnt")}, by)


def auroc(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve by mid-ranks; distinct scores are ranked, not rows."""
    r = _ranked(df, by, y, p, descending=False)
    mid = F.col("cum_n") - (F.col("cnt") - 1) / 2.0
    g = r.groupBy(*by).agg(F.sum(mid * F.col("pos")).alias("ranks"), F.sum("pos").alias("np"), F.sum(F.col("cnt") - F.col("pos")).alias("nn"))
    return g.select(*by, F.try_divide(F.col("ranks") - F.col("np") * (F.col("np") + 1) / 2.0, (F.col("np") * F.col("nn")).cast("double")).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    r = _ranked(df, by, y, p, descending=True)
    g = r.groupBy(*by).agg(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("s"), F.sum("pos").alias("np"))
    return g.select(*by, F.try_divide("s", "np").alias("average_precision"))


def bin_of(p: Column, edges: tuple[float, ...] = BIN_EDGES) -> Column:
    """Index of the bin, the last one closed."""
    inner = sum(((p >= F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    return inner


def reliability(df: DataFrame, by: list[str], y: str = "y", p: str = "p", edges: tuple[float, ...] = BIN_EDGES) -> DataFrame:
    """A row for every bin of every group, empty ones with null means."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)], "bin int, lo double, hi double")
    got = df.groupBy(*by, bin_of(F.col(p), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"))
    frame = df.select(*by).distinct().crossJoin(F.broadcast(bins)) if by else bins
    return frame.join(got, [*by, "bin"], "left").fillna(0, subset=["n"])


def frequency_framing(df: DataFrame, p: str, table: DataFrame) -> DataFrame:
    """Each probability with its bin of a reliability table: 'of n like it, so many were positive'."""
    bins = table.select("bin", F.col("n").alias("bin_n"), "fraction_positive")
    return df.withColumn("bin", bin_of(F.col(p))).join(bins, "bin", "left").withColumn("of_100", F.bround(F.col("fraction_positive") * 100, 0).cast("int"))


def no_call_metrics(df: DataFrame, by: list[str], mask: str, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    right = ((F.col(p) >= threshold).cast("int") == F.col(y)).cast("double")
    return df.groupBy(*by).agg(F.avg(F.col(mask).cast("double")).alias("no_call_rate"), F.sum((~F.col(mask)).cast("int")).alias("n_called"), F.avg(F.when(~F.col(mask), right)).alias("accuracy_after_no_call"))


def risk_coverage(df: DataFrame, position: str, y: str = "y", p: str = "p", threshold: float = 0.5, points: int = 20) -> DataFrame:
    """Accuracy of the most confident shares of the rows; ties by ``position``."""
    conf = F.greatest(F.col(p), 1 - F.col(p))
    hit = (F.col(p) >= threshold).cast("int")
    rows = df.select(conf.alias("conf"), F.col(position).alias("pos"), F.col(y).cast("int").alias("y"), hit.alias("hit"))
    cum = prefix_sums(
        rows, [F.col("conf").desc(), F.col("pos").asc()],
        {"k": F.lit(1), "right": (F.col("y") == F.col("hit")).cast("int"), "n1": F.col("y"), "tp": F.col("y") * F.col("hit"), "tn": (1 - F.col("y")) * (1 - F.col("hit"))},
    )
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "point int, k long, coverage double, accuracy double, balanced_accuracy double")
    wanted = [(i, max(1, int(round(float(f) * n)))) for i, f in enumerate(np.linspace(1.0, max(1.0 / n, 0.05), points))]
    want = df.sparkSession.createDataFrame(wanted, "point int, k long")
    at = cum.withColumn("k", F.col("k").cast("long")).join(F.broadcast(want), "k")
    bal = (F.try_divide("tp", "n1") + F.try_divide(F.col("tn"), F.col("k") - F.col("n1"))) / 2
    return at.select("point", "k", (F.col("k") / F.lit(float(n))).alias("coverage"), (F.col("right") / F.col("k")).alias("accuracy"), bal.alias("balanced_accuracy"))


def with_groups(df: DataFrame, split: str, seen: tuple[str, ...] = ("train", "calibration", "test")) -> DataFrame:
    """Rows once for their split and once for the group of splits that a model may have seen."""
    member = F.array(F.struct(F.lit("split").alias("kind"), F.col(split).alias("name")), F.struct(F.lit("group").alias("kind"), F.when(F.col(split).isin(*seen), "seen").otherwise("heldout").alias("name")))
    return df.withColumn("__m", F.explode(member)).select("*", "__m.kind", "__m.name").drop("__m")


def bootstrap_ci(df: DataFrame, cluster: str, y: str = "y", p: str = "p", threshold: float = 0.5, draws: int = 1000, seed: int = 0, metric: str = "balanced_accuracy") -> tuple[float, float] | None:
    """95 % interval of ``balanced_accuracy``, ``brier`` or ``auroc`` over resampled clusters; None
    where it can't be told: fewer than two clusters, one class, or fewer than 20 draws with both.

    A cluster is reduced to a few sums first, for the area under the curve to its counts of positives
    and negatives at each distinct score; only those reach the driver.
    """
    hit = F.col(p) >= threshold
    n = lambda c: F.sum(c.cast("int"))
    rng = np.random.default_rng(seed)
    if metric == "auroc":
        per = df.groupBy(F.col(cluster).alias("k"), F.col(p).alias("p")).agg(n(F.col(y) == 1).alias("pos"), n(F.col(y) == 0).alias("neg")).collect()
        names = sorted({r.k for r in per})
        scores = np.unique([r.p for r in per])
        at = {k: i for i, k in enumerate(names)}
        row, column = np.array([at[r.k] for r in per], int), np.searchsorted(scores, [r.p for r in per])
        pos, neg = np.array([r.pos for r in per], float), np.array([r.neg for r in per], float)

        def one(times: np.ndarray) -> float | None:
            ps, ns = (np.bincount(column, x * times[row], len(scores)) for x in (pos, neg))
            below = np.cumsum(ns) - ns
            return float((ps * (below + ns / 2)).sum() / (ps.sum() * ns.sum())) if ps.sum() and ns.sum() else None

        size, both = len(names), pos.sum() > 0 and neg.sum() > 0
    else:
        square = F.sum(F.pow(F.col(p) - F.col(y), F.lit(2)))
        per = df.groupBy(cluster).agg(n((F.col(y) == 1) & hit).alias("tp"), n(F.col(y) == 1).alias("np"), n((F.col(y) == 0) & ~hit).alias("tn"), n(F.col(y) == 0).alias("nn"), square.alias("sq"))
        c = np.array([tuple(r)[1:] for r in per.orderBy(cluster).collect()], float).reshape(-1, 5)

        def one(times: np.ndarray) -> float | None:
            tp, n1, tn, n0, sq = times @ c
            if not n1 or not n0:
                return None
            return sq / (n1 + n0) if metric == "brier" else (tp / n1 + tn / n0) / 2

        size, both = len(c), len(c) and c[:, 1].sum() > 0 and c[:, 3].sum() > 0
    if metric not in ("balanced_accuracy", "brier", "auroc"):
        raise ValueError(metric)
    if size < 2 or not both:
        return None
    found = [one(np.bincount(rng.integers(0, size, size), minlength=size).astype(float)) for _ in range(draws)]
    found = [x for x in found if x is not None]
    if len(found) < 20:
        return None
    lo, hi = np.percentile(found, [2.5, 97.5])
    return float(lo), float(hi)


def _times(cluster: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each cluster (a 64-bit hash) is in each draw: a Poisson variable of mean 1 that depends on
    cluster, draw and seed alone, so all rows and tasks agree without a table of clusters."""
    x = cluster.astype(np.uint64)[:, None] ^ (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 63)) * np.uint64(0xD1B54A32D192ED03))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x ^ (x >> np.uint64(32))) * 2.0**-64
    return np.searchsorted(np.cumsum([np.exp(-1) / math.factorial(k) for k in range(20)]), u, "right").astype(np.float64)


def resampled_ci(df: DataFrame, cluster: str, y: str = "y", p: str = "p", threshold: float = 0.5, draws: int = 1000, seed: int = 0, metric: str = "balanced_accuracy", bins: int = 512) -> tuple[float, float] | None:
    """The interval of bootstrap_ci() with nothing per cluster on the driver: one aggregate, all draws at once.

    A task adds up its rows, each as often as its cluster is in each draw (_times), and gives one row
    a draw. For the area under the curve it gives one a bin of scores: where there are at most
    ``bins`` different scores each is a bin, else bins are quantiles, and scores within one count as
    equal. None where bootstrap_ci() gives it. Rows with a null in cluster, y or p are left out.
    """
    if metric not in ("balanced_accuracy", "brier", "auroc"):
        raise ValueError(metric)
    rows = df.select(F.xxhash64(cluster).alias("k"), F.col(cluster).alias("c"), F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p")).dropna()
    few = rows.select("c").distinct().limit(2).count()
    if few < 2 or rows.select("y").distinct().filter("y in (0, 1)").count() < 2:
        return None
    edges = np.zeros(0)
    if metric == "auroc":
        some = [r.p for r in rows.select("p").distinct().limit(bins + 1).collect()]
        if len(some) > bins:
            some = rows.agg(F.percentile_approx("p", [(i + 1) / bins for i in range(bins)], 10 * bins)).first()[0]
        edges = np.unique(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, max(1, len(edges)), draws)) if metric == "auroc" else np.zeros((5, draws))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                y, p = part.column("y").to_numpy(), part.column("p").to_numpy()
                kinds, of = np.unique(part.column("k").to_numpy().view(np.uint64), return_inverse=True)
                times = _times(kinds, draws, seed)
                if metric == "auroc":
                    bin_ = np.minimum(np.searchsorted(edges, p), len(edges) - 1)
                    for side, value in ((0, 1), (1, 0)):
                        n = np.zeros((len(edges), len(kinds)))
                        np.add.at(n, (bin_[y == value], of[y == value]), 1)
                        hit = np.flatnonzero(n.any(1))
                        sums[side][hit] += n[hit] @ times
                else:
                    hit = p >= threshold
                    for i, v in enumerate(((y == 1) & hit, y == 1, (y == 0) & ~hit, y == 0, (p - y) ** 2)):
                        sums[i] += np.bincount(of, v.astype(float), len(kinds)) @ times
        flat = sums.reshape(-1, draws)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], names=["i", "s"])

    parts = rows.select("k", "y", "p").mapInArrow(run, "i int, s array<double>")

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = t["s"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, draws).sum(0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([total], pa.list_(pa.float64()))})

    found = np.zeros((2 * len(edges) if metric == "auroc" else 5, draws))
    for r in parts.groupBy("i").applyInArrow(add, "i int, s array<double>").collect():  # five rows, or two a bin
        found[r.i] = r.s
    with np.errstate(invalid="ignore", divide="ignore"):
        if metric == "auroc":
            pos, neg = found.reshape(2, -1, draws)
            below = np.cumsum(neg, 0) - neg
            value = (pos * (below + neg / 2)).sum(0) / (pos.sum(0) * neg.sum(0))
        else:
            tp, n1, tn, n0, square = found
            value = square / (n1 + n0) if metric == "brier" else (tp / n1 + tn / n0) / 2
            value[(n1 == 0) | (n0 == 0)] = np.nan
    value = value[np.isfinite(value)]
    if len(value) < 20:
        return None
    lo, hi = np.percentile(value, [2.5, 97.5])
    return float(lo), float(hi)


SEEN = ("train", "calibration", "test")


def evaluation_rows(probabilities: DataFrame, labels: DataFrame, splits: DataFrame, no_calls: DataFrame | None = None, drug: str = "drug", entity: str = "entity") -> DataFrame:
    """``drug, entity, p, y, no_call, cluster, split``: what has both a probability and a label.

    An entity without a split keeps a null one and counts in no split; a missing no-call is a call.
    """
    keys = [drug, entity]
    rows = probabilities.select(*keys, "p").join(labels.select(*keys, "y"), keys)
    if no_calls is not None:
        rows = rows.join(no_calls.select(*keys, "no_call"), keys, "left")
    else:
        rows = rows.withColumn("no_call", F.lit(False))
    rows = rows.join(splits.select(entity, "cluster", "split"), entity, "left").filter("p is not null and y is not null")
    return rows.withColumn("no_call", F.coalesce("no_call", F.lit(False)))


def evaluate(rows: DataFrame, drug: str = "drug", threshold: float = 0.5) -> DataFrame:
    """A row for each drug and split and for each drug and group of splits (seen, held out): counts,
    recalls, balanced accuracy, F1, Brier score, areas, no-call rate, and all of it again for what
    was called. Null where a figure is undefined; splits without rows have no row."""
    by = [drug, "kind", "name"]
    member = with_groups(rows.filter("split is not null"), "split", SEEN)
    # A held-out group that is also a split of that name stays in both.
    member = member.withColumn("name", F.when((F.col("kind") == "group") & (F.col("name") == "heldout"), "heldout_group").otherwise(F.col("name")))
    out = confusion(member, by, threshold=threshold)
    for part in (auroc(member, by), average_precision(member, by), no_call_metrics(member, by, "no_call", threshold=threshold)):
        out = out.join(part, by, "left")
    called = confusion(member.filter(~F.col("no_call")), by, threshold=threshold)
    return out.join(called.select(*by, *[F.col(c).alias(f"{c}_called") for c in called.columns if c not in (*by, "n")]), by, "left")


def evaluate_all(probabilities: DataFrame, labels: DataFrame, splits: DataFrame, no_calls: DataFrame | None = None, drug: str = "drug", entity: str = "entity", draws: int = 1000, seed: int = 0, threshold: float = 0.5) -> dict:
    """Everything about every drug as one nested dict, ready for JSON: for each split and group the
    metrics, an interval over clusters, the reliability table and the risk-coverage curve."""
    rows = evaluation_rows(probabilities, labels, splits, no_calls, drug, entity).cache()
    out: dict = {r[drug]: {"n_labeled": r["count"], "splits": {}, "groups": {}} for r in rows.groupBy(drug).count().collect()}
    try:
        for r in evaluate(rows, drug, threshold).collect():  # a row a drug and split
            names = SEEN if (r["kind"], r["name"]) == ("group", "seen") else (r["name"],)
            part = rows.filter((F.col(drug) == r[drug]) & F.col("split").isin(*names))
            block = {k: v for k, v in r.asDict().items() if k not in (drug, "kind", "name")}
            for metric in ("balanced_accuracy", "auroc", "brier"):
                block[f"{metric}_ci95_over_clusters"] = bootstrap_ci(part, "cluster", draws=draws, seed=seed, threshold=threshold, metric=metric)
            block["reliability"] = [x.asDict() for x in reliability(part, []).orderBy("bin").collect()]
            block["risk_coverage"] = [x.asDict() for x in risk_coverage(part, entity, threshold=threshold).orderBy("point").collect()]
            out[r[drug]]["splits" if r["kind"] == "split" else "groups"][r["name"]] = block
    finally:
        rows.unpersist()
    return out


def benchmark_run(status: DataFrame) -> tuple[DataFrame, int]:
    """Summary of benchmark_status() and the run's exit code: means of what isn't null, the worst
    status of all drugs, 1 if any is blocked or failed. No drugs at all are blocked too."""
    worst = F.when(F.col("n_drugs") == 0, "blocked").when(F.col("blocked") > 0, "blocked").when(F.col("fail") > 0, "fail").when(F.col("warn") > 0, "warn").otherwise("pass")
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    table = status.agg(F.count(F.lit(1)).alias("n_drugs"), F.avg("balanced_accuracy").alias("mean_balanced_accuracy"), *[n(s) for s in ("pass", "warn", "fail", "blocked")]).withColumn("status", worst)
    return table, int(table.first().status in ("blocked", "fail"))


def evaluation_report(per_drug: DataFrame, skipped: DataFrame, n_entities: int, least_entities: int = 100) -> DataFrame:
    """A row per drug: trained ones with ``passes_eval``, ``quality_status`` and ``issues``, others with
    why they were left out.

    ``per_drug``: drug, n_train, train_r, n_test, test_r, test_s, recall_resistant. ``skipped``: drug,
    skip_reason.
    """
    from phenospark.functions import scoring

    c = F.col
    enough = (c("test_r") >= 1) & (c("test_s") >= 1) & (c("n_test") >= 5)
    blind = F.coalesce((c("recall_resistant") == 0.0) & (c("test_r") > 0), F.lit(False))
    issues = scoring.quality_issues(c("n_test"), c("test_r"), c("test_s"), c("train_r"), c("recall_resistant"))
    done = per_drug.select("drug", F.lit("trained").alias("training_status"), (enough & ~blind).alias("passes_eval"), issues.alias("issues"), F.lit(None).cast("string").alias("skip_reason"))
    left = skipped.select("drug", F.lit("skipped").alias("training_status"), F.lit(False).alias("passes_eval"), F.array("skip_reason").alias("issues"), F.coalesce("skip_reason", F.lit("unknown")).alias("skip_reason"))
    quality = F.when(c("training_status") == "skipped", F.lit(None).cast("string")).when(F.size("issues") > 0, "warn").otherwise("pass")
    cohort = F.lit("few_entities" if n_entities < least_entities else None).cast("string")
    return done.unionByName(left).withColumn("quality_status", quality).withColumn("cohort_issue", cohort)


def compare_runs(now: DataFrame, before: DataFrame, keys: list[str], value: str, eps: float = 0.01) -> DataFrame:
    """Full join of two runs with ``delta`` and a verdict."""
    j = now.select(*keys, F.col(value).alias("now")).join(before.select(*keys, F.col(value).alias("before")), keys, "full")
    d = F.col("now") - F.col("before")
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(d > eps, "improved").when(d < -eps, "regressed").otherwise("held")
    return j.withColumn("delta", d).withColumn("verdict", verdict)


def benchmark_status(df: DataFrame, entities: int = 100, test: int = 5, resistant: int = 1, susceptible: int = 1) -> DataFrame:
    """``drug, n_entities, n_test, n_r, n_s, balanced_accuracy`` with a status: the worst thing that holds."""
    c = F.col
    status = F.when(c("balanced_accuracy").isNull() & (c("n_test") == 0), "blocked").when((c("n_r") < resistant) | (c("n_s") < susceptible), "fail").when((c("n_entities") < entities) | (c("n_test") < test), "warn").otherwise("pass")
    return df.withColumn("status", status)
