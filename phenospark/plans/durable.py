"""Queries of streams that survive restarts, snapshots, forests as tables and resampled intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.operators import evidence, metrics, name_index, store, trees
from phenospark.sources import feature_store
from phenospark.storage import scratch
from phenospark.streaming import counts, durable, status

from .queries import PART_RULES, query
from .tables import PRESENCE_SQL, presence, scored, table


@query("stream_sums", "SELECT event_type, user_id % 100 AS part, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_sums(spark, d):
    stream = counts.stream_folder(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)
    sums = durable.SumTable(scratch(spark, "stream-sums"), ("event_type", "part"), ("n", "total"))
    rows = stream.select("event_type", (F.col("user_id") % 100).alias("part"), F.lit(1).cast("long").alias("n"), F.col("event_id").alias("total"))
    durable.keep(rows, sums, scratch(spark, "stream-sums-checkpoint"))
    return sums.read(spark)


#: Orders by status as steps of a customer's job: an open one comes first, and a part is not followed by an open one.
_STEPS = {"": ("O", "F", "P"), "O": ("O", "F", "P"), "F": ("O", "F", "P"), "P": ("F", "P")}


@query(
    "status_machine",
    """WITH RECURSIVE e AS (SELECT o_custkey AS key, o_orderstatus AS status, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
walk AS (SELECT key, k, status AS now, true AS accepted, o_orderkey FROM e WHERE k = 1
UNION ALL SELECT e.key, e.k, CASE WHEN w.now = 'P' AND e.status = 'O' THEN w.now ELSE e.status END, NOT (w.now = 'P' AND e.status = 'O'), e.o_orderkey FROM walk w JOIN e ON e.key = w.key AND e.k = w.k + 1)
SELECT key, o_orderkey AS place, accepted, now FROM walk""",
)
def status_machine(spark, d):
    # One batch, as the table's rows are not in the order of their time.
    stream = counts.stream_folder(spark, f"{d}/order[s].parquet", table(spark, d, "orders").schema, files=1_000_000)
    log = scratch(spark, "status-log")
    status.run(status.machine(stream, "o_custkey", "o_orderstatus", "o_orderdate", F.col("o_orderkey"), _STEPS, waiting=(), late="36500 days"), log, scratch(spark, "status-checkpoint"))
    return spark.read.parquet(log).select("key", "place", "accepted", "now")


@query(
    "feature_snapshot",
    f"""WITH {PRESENCE_SQL}, per AS (SELECT l_suppkey, count(*) AS n FROM presence GROUP BY ALL)
SELECT (SELECT count(*) FROM supplier) AS n_entities, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM per)) AS n_without_features, (SELECT count(*) FROM presence) AS n_values,
  (SELECT count(DISTINCT p_brand) FROM presence) AS n_features, (SELECT count(*) FROM part) AS n_hits, (SELECT max(n) FROM per) AS most, (SELECT min(n) FROM (SELECT count(*) AS n FROM presence GROUP BY p_brand)) AS rarest""",
)
def feature_snapshot(spark, d):
    path = scratch(spark, "snapshots")
    feature_store.write(presence(spark, d), table(spark, d, "part"), path, "l_suppkey", "p_brand", ["p_type", "p_brand"], table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")))
    s = feature_store.read(spark, path)
    counted = [F.lit(s.manifest[c]).cast("long").alias(c) for c in ("n_entities", "n_without_features", "n_values", "n_features", "n_hits")]
    rarest = s.catalog.agg(F.min("n_entities").alias("rarest"))
    return s.index.agg(F.max("n_features").alias("most")).crossJoin(rarest).select(*counted, "most", "rarest")  # two rows of one


#: A tree for each brand: without it 0.1 or 0.6 by its number, with it by whether the next brand is there.
@query(
    "forest_scores",
    f"""WITH {PRESENCE_SQL}, b AS (SELECT p_brand, lead(p_brand, 1, p_brand) OVER (ORDER BY p_brand) AS other, CAST(substr(p_brand, 7) AS INT) % 2 AS odd FROM (SELECT DISTINCT p_brand FROM part)),
v AS (SELECT s_suppkey, CASE WHEN x.p_brand IS NULL THEN CASE WHEN odd = 1 THEN 0.6 ELSE 0.1 END WHEN y.p_brand IS NULL THEN 0.3 ELSE 0.9 END AS value
  FROM supplier CROSS JOIN b LEFT JOIN presence x ON x.l_suppkey = s_suppkey AND x.p_brand = b.p_brand LEFT JOIN presence y ON y.l_suppkey = s_suppkey AND y.p_brand = b.other)
SELECT s_suppkey, 'pairs' AS model, round(avg(CAST(value AS DOUBLE)), 6) AS p FROM v GROUP BY ALL""",
)
def forest_scores(spark, d):
    from pyspark.sql.window import Window

    brands = table(spark, d, "part").select("p_brand").distinct()
    order = Window.orderBy("p_brand")  # a few dozen brands
    b = brands.select("p_brand", F.lead("p_brand", 1).over(order).alias("next"), F.row_number().over(order).alias("tree"), (F.substring("p_brand", 7, 9).cast("int") % 2).alias("odd"))
    node = lambda n, feature, left, right, value: F.struct(F.lit(n).alias("node"), feature.alias("feature"), F.lit(0.5).alias("threshold"), F.lit(left).cast("int").alias("left"), F.lit(right).cast("int").alias("right"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    rows = F.array(
        node(0, F.col("p_brand"), 1, 2, F.lit(None)), node(1, none, None, None, F.when(F.col("odd") == 1, 0.6).otherwise(0.1)),
        node(2, F.coalesce("next", "p_brand"), 3, 4, F.lit(None)), node(3, none, None, None, F.lit(0.3)), node(4, none, None, None, F.lit(0.9)),
    )
    nodes = b.select(F.lit("pairs").alias("model"), "tree", F.explode(rows).alias("x")).select("model", "tree", "x.*")
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    found = trees.forest_scores(presence(spark, d), ids, nodes, "l_suppkey", "p_brand")
    return found.select(F.col("l_suppkey").alias("s_suppkey"), "model", F.round("p", 6).alias("p"))


@query("resampled_ci")
def resampled_ci(spark, d):
    """Documents as clusters, each metric: far more clusters than a driver would want a row of."""
    rows = [(m, *(metrics.resampled_ci(scored(spark, d), "doc_id", metric=m, draws=300) or (None, None))) for m in ("balanced_accuracy", "brier", "auroc")]
    return spark.createDataFrame(rows, "metric string, low double, high double")


@query(
    "name_search",
    """WITH now AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'Renamed ' || c_name ELSE c_name END AS c_name FROM customer),
q AS (SELECT * FROM (VALUES ('cust 00000001', 'cust', '00000001'), ('renamed', 'renamed', 'renamed'), ('99', '99', '99'), ('nobody here', 'nobody', 'here')) v(text, one, two)),
named AS (SELECT text, c_custkey, c_name, row_number() OVER (PARTITION BY text ORDER BY c_custkey) AS k FROM now, q
  WHERE EXISTS (SELECT 1 FROM unnest(regexp_split_to_array(lower(c_name), '[^a-z0-9]+')) w(x) WHERE starts_with(x, one)) AND EXISTS (SELECT 1 FROM unnest(regexp_split_to_array(lower(c_name), '[^a-z0-9]+')) w(x) WHERE starts_with(x, two)))
SELECT text, c_custkey, c_name FROM named WHERE k <= 20 UNION SELECT text, c_custkey, c_name FROM now, q WHERE contains(CAST(c_custkey AS VARCHAR), text)""",
)
def name_search(spark, d):
    """Searches from postings of all customers, a tenth of which got another name in an upsert."""
    index = name_index.NameIndex(scratch(spark, "name-index"), "c_custkey", "c_name", buckets=16)
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    changed = c.filter("c_custkey % 10 = 3")
    index.add(c, 0)
    index.add(changed.withColumn("c_name", F.concat(F.lit("Renamed "), "c_name")), 1, changed)
    found = [index.search(spark, text).select(F.lit(text).alias("text"), "c_custkey", "c_name") for text in ("cust 00000001", "renamed", "99", "nobody here")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


#: Rules of PART_RULES with the references that back them; one is in no list of sources.
_RULE_REFS = [("a", "brand_1_small", ["s1", "s2"]), ("a", "any_brand_2", ["s3"]), ("a", "promo", []), ("b", "large", ["s2", "lost", "s1"])]
_SOURCES = [("s1", "First et al. 2020; a journal", "A title"), ("s2", "", "Second; with a clause"), ("s3", " Third ;", "")]


@query(
    "citations",
    """WITH r(p_partkey, drug, rule) AS (
SELECT p_partkey, 'a', CASE WHEN p_brand = 'Brand#15' THEN NULL WHEN starts_with(p_brand, 'Brand#1') AND contains(p_type, 'SMALL') THEN 'brand_1_small' WHEN starts_with(p_brand, 'Brand#2') THEN 'any_brand_2' WHEN starts_with(p_type, 'PROMO') THEN 'promo' END FROM part
UNION ALL SELECT p_partkey, 'b', CASE WHEN p_type = 'LARGE' THEN 'large' WHEN regexp_matches(p_brand, '^Brand#[0-9][135]$') THEN 'brand_odd' END FROM part)
SELECT p_partkey, drug, rule, CASE drug || rule WHEN 'abrand_1_small' THEN 'First et al. 2020; Second' WHEN 'aany_brand_2' THEN 'Third' WHEN 'blarge' THEN 'Second; lost; First et al. 2020' ELSE '' END AS citations FROM r WHERE rule IS NOT NULL""",
)
def citations(spark, d):
    hits = evidence.map_hits(table(spark, d, "part"), PART_RULES, "p_brand", None, "p_type", None).select("p_partkey", "drug", "rule")
    rules = spark.createDataFrame(_RULE_REFS, "drug string, rule string, refs array<string>")
    sources = spark.createDataFrame(_SOURCES, "ref string, cite string, title string")
    return evidence.with_citations(hits, rules, sources).withColumn("citations", F.array_join("citations", "; "))


@query(
    "genome_documents",
    f"""WITH {PRESENCE_SQL}, n AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier),
g AS (SELECT l_suppkey, list({{'brand': p_brand}} ORDER BY p_brand) AS evidence FROM presence GROUP BY ALL),
t AS (SELECT l_suppkey, l_returnflag, count(*) AS n, max(l_linenumber) AS most FROM lineitem GROUP BY ALL),
f AS (SELECT l_suppkey, '{{' || string_agg('"' || l_returnflag || '":' || CAST(to_json({{'n': n, 'most': most}}) AS VARCHAR), ',' ORDER BY l_returnflag) || '}}' AS flags FROM t GROUP BY ALL)
SELECT s_suppkey, '{{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"evidence":' || coalesce(CAST(to_json(evidence) AS VARCHAR), '[]') || ',"flags":' || coalesce(flags, '{{}}') || '}}' AS value
FROM n LEFT JOIN g ON g.l_suppkey = s_suppkey LEFT JOIN f ON f.l_suppkey = s_suppkey""",
)
def genome_documents(spark, d):
    key = F.col("l_suppkey").alias("s_suppkey")
    counted = table(spark, d, "lineitem").groupBy(key, "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("most"))
    parts = {"evidence": (presence(spark, d).select(key, F.col("p_brand").alias("brand")), None, ["brand"]), "flags": (counted, "l_returnflag", ["n", "most"])}
    return store.genome_documents(table(spark, d, "supplier"), parts, "s_suppkey", ["s_name", "s_nationkey"])
