"""Splits that keep clusters whole, and audits of what leaks across them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions import constants as K

from .ordered import prefix_sums


def heldout_clusters(clusters: DataFrame, cluster: str, n: int = K.HELDOUT_CLUSTERS) -> DataFrame:
    """The n largest clusters (ties: the smaller id), as ``cluster, size``."""
    return clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), cluster).limit(n)


def greedy_assign(sizes: list[tuple], shares: dict[str, float] | None = None, have: dict[str, float] | None = None, total: float | None = None, seed: int | None = None) -> dict:
    """Cluster -> split: the largest cluster first, to the split that is furthest below its share.

    Deficits count relative to the share. Splits that are equally far below come in their order, or
    with a ``seed`` in one drawn anew for each cluster. ``have`` are sizes that the splits hold already.
    """
    shares = shares or K.SPLIT_SHARES
    have = dict.fromkeys(shares, 0.0) | (have or {})
    total = sum(n for _, n in sizes) if total is None else total
    rng, out = np.random.default_rng(seed), {}
    for c, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        jitter = rng.random(len(shares)) if seed is not None else -np.arange(len(shares))
        best = max(enumerate(shares), key=lambda x: ((shares[x[1]] * total - have[x[1]]) / shares[x[1]], jitter[x[0]]))[1]
        out[c] = best
        have[best] += n
    return out


def stratified_folds(clusters: list[tuple], k: int, seed: int = 0) -> dict:
    """Cluster -> fold, from (cluster, majority label): each class is dealt round in an order by chance,
    starting where the class before stopped, so folds have equally many clusters of each class, but
    for one, and equally many in all."""
    rng, out, at = np.random.default_rng(seed), {}, 0
    for label in sorted({y for _, y in clusters}):
        names = sorted(c for c, y in clusters if y == label)
        for c in rng.permutation(len(names)):
            out[names[c]] = at % k
            at += 1
    return out


def peel_folds(fold_sizes: dict[int, int], shares: dict[str, float]) -> dict[int, str]:
    """Fold -> split: the smallest split takes the smallest folds until it has its share, and so on;
    the largest split takes what is left, however little the others left."""
    total, left, out = sum(fold_sizes.values()), sorted(fold_sizes, key=lambda f: (fold_sizes[f], f)), {}
    names = sorted(shares, key=lambda s: (shares[s], s))
    for i, name in enumerate(names):
        held = 0
        while left and (i == len(names) - 1 or held < shares[name] * total and len(left) > len(names) - 1 - i):
            f = left.pop(0)
            out[f] = name
            held += fold_sizes[f]
    return out


def stratified_assign(clusters: list[tuple], shares: dict[str, float] | None = None, seed: int = 0) -> dict:
    """Cluster -> split from (cluster, size, majority label or None).

    Clusters with a label are dealt to folds by label, as many as the smallest share needs, and folds
    to splits. Those without one go where sizes fall short. With too few labelled clusters or one class
    all go by size.
    """
    shares = shares or K.SPLIT_SHARES
    known = [x for x in clusters if x[2] is not None]
    classes = [sum(y == v for *_, y in known) for v in {y for *_, y in known}]
    k = max(2, round(1 / min(shares.values())))
    if len(known) < k or len(classes) != 2 or min(classes) < k:
        return greedy_assign([(c, n) for c, n, _ in clusters], shares, seed=seed)
    fold = stratified_folds([(c, y) for c, _, y in known], k, seed)
    sizes = dict.fromkeys(range(k), 0)
    for c, n, _ in known:
        sizes[fold[c]] += n
    split_of = peel_folds(sizes, shares)
    out = {c: split_of[f] for c, f in fold.items()}
    have = dict.fromkeys(shares, 0.0)
    for c, n, _ in known:
        have[out[c]] += n
    rest = [(c, n) for c, n, y in clusters if y is None]
    return out | greedy_assign(rest, shares, have, sum(sizes.values()), seed + 1)


def assign_splits(clusters: DataFrame, node: str, cluster: str, labels: DataFrame | None = None, label: str = "y", n_heldout: int = K.HELDOUT_CLUSTERS, shares: dict[str, float] | None = None, most_clusters: int = 1_000_000) -> DataFrame:
    """``node, cluster, split``: the largest clusters are held out, the others are split whole.

    With labels, clusters are stratified by their members' mean label, rounded half to even. Sizes of
    clusters reach the driver, so their number is checked; beyond it, use hash_split().
    """
    held = heldout_clusters(clusters, cluster, n_heldout)
    sizes = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    if labels is None:
        sizes = sizes.withColumn("__y", F.lit(None).cast("int"))
    else:
        major = clusters.join(labels, node).groupBy(cluster).agg(F.bround(F.avg(label), 0).cast("int").alias("__y"))
        sizes = sizes.join(major, cluster, "left")
    rest = sizes.join(held.select(cluster), cluster, "left_anti")
    if rest.limit(most_clusters + 1).count() > most_clusters:
        raise ValueError("too many clusters for the driver; use hash_split()")
    plan = stratified_assign([(r[cluster], r["size"], r["__y"]) for r in rest.collect()], shares)
    kind = dict(clusters.dtypes)[cluster]
    table = clusters.sparkSession.createDataFrame(list(plan.items()), f"{cluster} {kind}, split string")
    joined = clusters.join(table, cluster, "left")
    return joined.select(node, cluster, F.coalesce("split", F.lit("heldout_group")).alias("split"))


def reserve_test(clusters: DataFrame, cluster: str, positive: str, train: float = 0.7, calibration: float = 0.15, seed: int = 13) -> DataFrame:
    """``cluster, split`` with quotas by number of clusters; clusters with a positive member reach the
    test split first.

    Half the test quota (two clusters at least) is theirs, if there are so many; the rest of the quota
    comes from all others. Orders are by hash, so any number of clusters can be split.
    """
    flags = clusters.groupBy(cluster).agg(F.max(F.col(positive).cast("int")).alias("__pos"))
    n = flags.count()
    n_train, n_cal = max(1, round(n * train)), max(1, round(n * calibration))
    if n_train + n_cal >= n:
        n_cal = max(1, n - n_train - 1)
    n_test = max(1, n - n_train - n_cal)

    def ranked(df: DataFrame, salt: int, by: list[str]) -> DataFrame:
        keyed = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed + salt), F.col(cluster).cast("string")).cast("binary")))
        return prefix_sums(keyed, [F.col("__h"), F.col(cluster)], {"__rank": F.lit(1)}, by).drop("__h")

    first = ranked(flags, 0, ["__pos"]).withColumn("__test", (F.col("__pos") == 1) & (F.col("__rank") <= max(2, n_test // 2))).drop("__rank")
    taken = first.filter("__test").count()
    second = ranked(first, 1, ["__test"]).withColumn("__test", F.col("__test") | (F.col("__rank") <= n_test - taken)).drop("__rank")
    third = ranked(second, 2, ["__test"])
    split = F.when(F.col("__test"), "test").when(F.col("__rank") <= n_train, "train").when(F.col("__rank") <= n_train + n_cal, "calibration").otherwise("test")
    return third.select(cluster, split.alias("split"))


def hash_split(clusters: DataFrame, cluster: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Whole clusters by hash; no state, so any number of clusters."""
    u = F.pmod(F.xxhash64(cluster), F.lit(1_000_003)) / 1_000_003.0
    expr, edge = None, 0.0
    for name, share in (shares or K.SPLIT_SHARES).items():
        edge += share
        expr = F.when(u < edge, name) if expr is None else expr.when(u < edge, name)
    return clusters.withColumn("split", expr.otherwise(name))


def random_split(rows: DataFrame, key: str, label: str, share: float = 0.8) -> DataFrame:
    """Within each class, the first ``share`` of rows in an order by hash are train; no row depends on chance."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    ranked = prefix_sums(rows.withColumn("__h", h), [F.col("__h"), F.col(key)], {"__rn": F.lit(1)}, [label])
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    part = F.when(F.col("__rn") <= F.col("__n") * share, "train").otherwise("test")
    return ranked.join(F.broadcast(n), label).withColumn("part", part).drop("__h", "__rn", "__n")  # one row a class


#: Folds that groups are dealt to; scoring out of fold goes through all of them.
FOLDS = 5


def group_folds(rows: DataFrame, group: str, k: int = FOLDS) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)).cast("int"))


def oversample(rows: DataFrame, label: str) -> DataFrame:
    """Repeat rows of the smaller class until it is as large; the first rows by hash get the odd copies."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if len(counts) != 2:
        return rows
    small = min(counts, key=lambda k: (counts[k], k))
    times, odd = divmod(max(counts.values()), counts[small])
    cols = rows.columns
    few = rows.filter(F.col(label) == small)
    ranked = prefix_sums(few.withColumn("__h", F.xxhash64(*cols)).withColumn("__i", F.monotonically_increasing_id()), [F.col("__h"), F.col("__i")], {"__rn": F.lit(1)})
    copies = F.explode(F.sequence(F.lit(1), F.lit(times) + (F.col("__rn") <= odd).cast("int")))
    return rows.filter(F.col(label) != small).unionByName(ranked.withColumn("__k", copies).select(*cols))


def leakage_audit(edges: DataFrame, splits: DataFrame, a: str, b: str, score: str, node: str, cluster: str, split: str, least: float) -> DataFrame:
    """One row: clusters in more than one split, highest score across splits, edges across that reach
    ``least``, highest score between train and held-out nodes."""
    s1 = splits.select(F.col(node).alias(a), F.col(split).alias("__s_a"))
    s2 = splits.select(F.col(node).alias(b), F.col(split).alias("__s_b"))
    return audit_of_marked(edges.join(s1, a).join(s2, b), splits, score, "__s", cluster, split, least)


def audit_of_marked(edges: DataFrame, splits: DataFrame, score: str, mark: str, cluster: str, split: str, least: float) -> DataFrame:
    """leakage_audit() of edges that know the splits of both ends, ``mark_a, mark_b``: they are added up where they are."""
    spans = splits.groupBy(cluster).agg(F.countDistinct(split).alias("k")).agg(F.sum((F.col("k") > 1).cast("int")).alias("spanning_clusters"))
    one, two = f"{mark}_a", f"{mark}_b"
    cross = edges.filter(F.col(one) != F.col(two))
    th = F.array_sort(F.array(one, two)) == F.array(F.lit("heldout_group"), F.lit("train"))
    agg = cross.agg(F.max(score).alias("max_cross"), F.coalesce(F.sum((F.col(score) >= least).cast("int")), F.lit(0)).alias("violations"), F.max(F.when(th, F.col(score))).alias("max_train_heldout"))
    return spans.crossJoin(agg)  # one row each


def shared_features(long: DataFrame, groups: DataFrame, entity: str, feature: str, group: str, one: Column, two: Column) -> DataFrame:
    """One row comparing the feature sets of two groups of entities: sizes, overlap, Jaccard (null if both are empty)."""
    j = long.join(groups, entity).select(F.col(feature).alias("f"), one.alias("__1"), two.alias("__2"))
    per = j.groupBy("f").agg(F.max("__1").alias("a"), F.max("__2").alias("b"))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    g = per.agg(n(F.col("a")).alias("n_one"), n(F.col("b")).alias("n_two"), n(F.col("a") & F.col("b")).alias("n_both"), n(F.col("a") | F.col("b")).alias("n_any"))
    return g.withColumn("jaccard", F.try_divide("n_both", "n_any"))


def cluster_summary(sizes: DataFrame, size: str = "size") -> DataFrame:
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.sum(size).alias("nodes"), F.min(size).alias("smallest"), F.max(size).alias("largest"), F.floor(F.percentile(size, F.lit(0.5))).alias("median"))
