"""More queries of the catalogue: training and evaluation tables, gates, texts, documents, and sources
and sinks by a round trip through the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.functions import normalize as N
from phenospark.functions import scoring as S
from phenospark.functions import sequence as Q
from phenospark.operators import cleaning, evidence, features, gates, labels, metrics, nocall, similarity, splits, store, training
from phenospark.sources import readers, writers
from phenospark.storage import scratch
from phenospark.streaming import counts

from .queries import query, r6
from .tables import SCORED_SQL, scored, table


# ---------------------------------------------------------------- training and evaluation

_SPLIT = "CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'calibration' WHEN doc_id % 10 = 8 THEN 'test' ELSE 'heldout_group' END"


def _split() -> Column:
    return F.expr(_SPLIT)


@query(
    "training_rows",
    f"""WITH l AS (SELECT doc_id, arg_min(quality, toxic * 10 + quality) AS y FROM labels GROUP BY doc_id)
SELECT l.doc_id, d.lang, CAST(y AS BIGINT) AS y, d.n_chars, {_SPLIT.replace('doc_id', 'l.doc_id')} AS split FROM l JOIN documents d USING (doc_id)""",
)
def training_rows(spark, d):
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.col("quality").cast("long").alias("y"), (F.col("toxic") * 10 + F.col("quality")).alias("position"))
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    return training.training_rows(lab, doc, doc.select("doc_id", _split().alias("split")), "doc_id", "lang", "position").select("doc_id", "lang", "y", "n_chars", "split")


_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE {split} AND {ok}) AS {name}{suffix}"
    for suffix, split in [("", "true"), *((f"_{s}", f"split = '{s}'") for s in ("train", "calibration", "test", "heldout_group"))]
    for name, ok in (("n", "true"), ("n_r", "y = 1"), ("n_s", "y = 0"))
)


@query("split_counts", f"WITH {SCORED_SQL}, s AS (SELECT *, {_SPLIT} AS split FROM scored) SELECT lang, {_COUNTS} FROM s GROUP BY lang")
def split_counts(spark, d):
    return training.split_counts(scored(spark, d).withColumn("split", _split()), "lang")


@query("logit_shift", f"WITH {SCORED_SQL} SELECT doc_id, round(1 / (1 + exp(-(ln(q / (1 - q)) - ln(0.4 / 0.6)))), 6) AS p FROM (SELECT doc_id, least(1 - 1e-9, greatest(1e-9, p)) AS q FROM scored)")
def logit_shift(spark, d):
    return scored(spark, d).select("doc_id", r6(S.logit_shift(F.col("p"), F.lit(0.4)), "p"))


@query(
    "evaluation_rows",
    f"""WITH {SCORED_SQL} SELECT doc_id, lang, p, y, coalesce(distance > 90, false) AS no_call, source AS cluster, {_SPLIT} AS split FROM scored WHERE y IS NOT NULL AND p IS NOT NULL""",
)
def evaluation_rows(spark, d):
    return _evaluation(spark, d)


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("split", _split())
    keys = ["lang", "doc_id"]
    far = s.filter("distance > 90").select(*keys, F.lit(True).alias("no_call"))
    return metrics.evaluation_rows(s.select(*keys, "p"), s.select(*keys, "y"), s.select("doc_id", F.col("source").alias("cluster"), "split"), far, "lang", "doc_id")


_EVAL_SQL = f"""WITH {SCORED_SQL}, s AS (SELECT *, distance > 90 AS no_call, {_SPLIT} AS split FROM scored),
m AS (SELECT *, 'split' AS kind, split AS name FROM s UNION ALL SELECT *, 'group', CASE WHEN split = 'heldout_group' THEN 'heldout_group' ELSE 'seen' END FROM s),
g AS (SELECT lang, kind, name, count(*) AS n, count(*) FILTER (y = 1) AS n_r, count(*) FILTER (y = 0) AS n_s,
  count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, avg((p - y) ** 2) AS brier, avg(CAST(no_call AS DOUBLE)) AS no_call_rate,
  count(*) FILTER (NOT no_call) AS n_called, count(*) FILTER (NOT no_call AND y = 1) AS c_r, count(*) FILTER (NOT no_call AND y = 0) AS c_s,
  count(*) FILTER (NOT no_call AND y = 1 AND p >= 0.5) AS c_tp, count(*) FILTER (NOT no_call AND y = 0 AND p < 0.5) AS c_tn FROM m GROUP BY ALL)"""


@query(
    "evaluate_splits_called",
    f"""{_EVAL_SQL} SELECT lang, kind, name, n, round((tp / nullif(n_r, 0) + tn / nullif(n_s, 0)) / 2, 6) AS balanced_accuracy, round(brier, 6) AS brier, round(no_call_rate, 6) AS no_call_rate,
  n_called, round((c_tp / nullif(c_r, 0) + c_tn / nullif(c_s, 0)) / 2, 6) AS balanced_accuracy_called FROM g""",
)
def evaluate_splits_called(spark, d):
    e = metrics.evaluate(_evaluation(spark, d), "lang")
    return e.select("lang", "kind", "name", "n", r6(F.col("balanced_accuracy"), "balanced_accuracy"), r6(F.col("brier"), "brier"), r6(F.col("no_call_rate"), "no_call_rate"), F.col("n_called").cast("long").alias("n_called"), r6(F.col("balanced_accuracy_called"), "balanced_accuracy_called"))


_STATUS_SQL = f"""WITH {SCORED_SQL}, b AS (SELECT source AS drug, count(*) AS n_entities, count(*) FILTER (doc_id % 10 = 8) AS n_test, count(*) FILTER (doc_id % 10 = 8 AND y = 1) AS n_r, count(*) FILTER (doc_id % 10 = 8 AND y = 0) AS n_s,
  (count(*) FILTER (doc_id % 10 = 8 AND y = 1 AND p >= 0.5) / nullif(count(*) FILTER (doc_id % 10 = 8 AND y = 1), 0) + count(*) FILTER (doc_id % 10 = 8 AND y = 0 AND p < 0.5) / nullif(count(*) FILTER (doc_id % 10 = 8 AND y = 0), 0)) / 2 AS ba FROM scored GROUP BY source)"""


def _per_source(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    all_ = s.groupBy(F.col("source").alias("drug")).agg(F.count(F.lit(1)).alias("n_entities"))
    test = metrics.confusion(s.filter("doc_id % 10 = 8").withColumnRenamed("source", "drug"), ["drug"])
    test = test.select("drug", F.col("n").alias("n_test"), F.col("n_resistant").alias("n_r"), F.col("n_susceptible").alias("n_s"), "balanced_accuracy", "recall_resistant")
    return all_.join(test, "drug", "left").fillna(0, subset=["n_test", "n_r", "n_s"])


@query(
    "benchmark_run",
    f"""{_STATUS_SQL}, s AS (SELECT *, CASE WHEN ba IS NULL AND n_test = 0 THEN 'blocked' WHEN n_r < 1 OR n_s < 1 THEN 'fail' WHEN n_entities < 100 OR n_test < 5 THEN 'warn' ELSE 'pass' END AS status FROM b)
SELECT count(*) AS n_drugs, round(avg(ba), 6) AS mean_balanced_accuracy, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'blocked') AS blocked,
  CASE WHEN count(*) = 0 OR bool_or(status = 'blocked') THEN 'blocked' WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS status FROM s""",
)
def benchmark_run(spark, d):
    table_, _ = metrics.benchmark_run(metrics.benchmark_status(_per_source(spark, d)))
    return table_.withColumn("mean_balanced_accuracy", F.round("mean_balanced_accuracy", 6))


@query(
    "evaluation_report",
    f"""WITH {SCORED_SQL}, t AS (SELECT lang AS drug, count(*) FILTER (doc_id % 10 < 6 AND y = 1) AS train_r, count(*) FILTER (doc_id % 10 = 8) AS n_test, count(*) FILTER (doc_id % 10 = 8 AND y = 1) AS test_r, count(*) FILTER (doc_id % 10 = 8 AND y = 0) AS test_s,
  count(*) FILTER (doc_id % 10 = 8 AND y = 1 AND p >= 0.5) AS tp FROM scored GROUP BY lang),
i AS (SELECT *, list_filter([CASE WHEN n_test < 10 THEN 'small_test' END, CASE WHEN test_r = 0 THEN 'no_resistant_in_test' END, CASE WHEN test_s = 0 THEN 'no_susceptible_in_test' END,
  CASE WHEN train_r < 5 THEN 'few_resistant_in_train' END, CASE WHEN test_r > 0 AND tp = 0 THEN 'zero_resistant_recall' END], lambda x: x IS NOT NULL) AS issues FROM t)
SELECT drug, 'trained' AS training_status, test_r >= 1 AND test_s >= 1 AND n_test >= 5 AND NOT (test_r > 0 AND tp = 0) AS passes_eval, array_to_string(issues, ',') AS issues, CASE WHEN len(issues) > 0 THEN 'warn' ELSE 'pass' END AS quality_status FROM i
UNION ALL SELECT 'untrained', 'skipped', false, 'no_amrfinder_features', NULL""",
)
def evaluation_report(spark, d):
    s = scored(spark, d).withColumnRenamed("lang", "drug")
    n = lambda c: F.count(F.when(c, 1))
    test, yes = F.col("doc_id") % 10 == 8, F.col("y") == 1
    train = F.col("doc_id") % 10 < 6
    per = s.groupBy("drug").agg(n(train).alias("n_train"), n(train & yes).alias("train_r"), n(test).alias("n_test"), n(test & yes).alias("test_r"), n(test & ~yes).alias("test_s"), n(test & yes & (F.col("p") >= 0.5)).alias("tp"))
    per = per.withColumn("recall_resistant", F.try_divide("tp", "test_r"))
    skipped = spark.createDataFrame([("untrained", "no_amrfinder_features")], "drug string, skip_reason string")
    return metrics.evaluation_report(per, skipped, 1000).select("drug", "training_status", "passes_eval", F.array_join("issues", ",").alias("issues"), "quality_status")


@query("train_all")
def train_all(spark, d):
    rows = scored(spark, d).withColumns({"split": _split(), "x1": F.log1p("n_chars"), "x2": F.col("p") + F.col("distance") / 500})
    return training.train_all(rows, ["x1", "x2"], drug="lang", cluster="source")[2]


@query("stratified_folds_split")
def stratified_folds_split(spark, d):
    s = scored(spark, d).select(F.col("doc_id").alias("node"), F.col("n_chars").alias("cluster"), "y")
    return splits.assign_splits(s.select("node", "cluster"), "node", "cluster", s.select("node", "y"), "y")


@query("genome_signatures")
def genome_signatures(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("contig", "line"))
    return similarity.genome_signatures(doc.select("doc_id", "contig", Q.to_dna(F.col("line")).alias("seq")), "doc_id", "contig", "seq", [0, 1234567, 1 << 40], k=31)


# ---------------------------------------------------------------- labels

_RAW_SQL = """e AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'Ciprofloxacin' WHEN 'view' THEN ' Ampicillin ' WHEN 'purchase' THEN 'cefalexin' ELSE 'unknown ' || event_type END AS name,
  CASE event_id % 4 WHEN 0 THEN 'Resistant' WHEN 1 THEN 'susceptible' WHEN 2 THEN 'Intermediate' ELSE '' END AS phenotype, CASE event_id % 5 WHEN 0 THEN '>' WHEN 1 THEN '<=' ELSE '=' END AS sign, floor(value) AS v,
  event_id % 3 <> 0 AS mic_like, event_id % 7 <> 0 AS unit_ok, 2015 + CAST((day(ts) - 1) // 7 AS INT) AS year, event_id % 10 <> 0 AS lab FROM events),
k AS (SELECT *, CASE trim(lower(name)) WHEN 'ciprofloxacin' THEN 'ciprofloxacin' WHEN 'ampicillin' THEN 'ampicillin' WHEN 'cefalexin' THEN 'cephalexin' END AS drug FROM e),
r AS (SELECT *, CASE lower(phenotype) WHEN 'resistant' THEN 1 WHEN 'susceptible' THEN 0 END AS submitted, CASE WHEN NOT mic_like OR NOT unit_ok OR drug = 'cephalexin' THEN NULL
  WHEN sign = '>' THEN CASE WHEN v >= CASE drug WHEN 'ciprofloxacin' THEN 120 ELSE 90 END THEN 1 END WHEN sign = '<=' THEN CASE WHEN v <= CASE drug WHEN 'ciprofloxacin' THEN 60 ELSE 80 END THEN 0 END
  WHEN v > CASE drug WHEN 'ciprofloxacin' THEN 120 ELSE 90 END THEN 1 WHEN v <= CASE drug WHEN 'ciprofloxacin' THEN 60 ELSE 80 END THEN 0 END AS rederived FROM k WHERE lab AND drug IS NOT NULL)"""


def _job(spark: SparkSession, d: str) -> cleaning.CleanLabels:
    """Events as a raw table of laboratory results, with all its columns as text."""
    i = F.col("event_id")
    name = F.when(F.col("event_type") == "click", "Ciprofloxacin").when(F.col("event_type") == "view", " Ampicillin ").when(F.col("event_type") == "purchase", "cefalexin").otherwise(F.concat(F.lit("unknown "), "event_type"))
    raw = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("Genome ID"), name.alias("Antibiotic"),
        F.when(i % 4 == 0, "Resistant").when(i % 4 == 1, "susceptible").when(i % 4 == 2, "Intermediate").otherwise("").alias("Resistant Phenotype"),
        F.when(i % 5 == 0, ">").when(i % 5 == 1, "<=").otherwise("=").alias("Measurement Sign"), F.floor("value").cast("string").alias("Measurement Value"),
        F.when(i % 7 == 0, "mm").otherwise("mg/L").alias("Measurement Unit"), F.when(i % 3 == 0, "Disk diffusion").otherwise("MIC").alias("Laboratory Typing Method"),
        F.lit("EUCAST").alias("Testing Standard"), (F.lit(2015) + F.floor((F.dayofmonth("ts") - 1) / 7)).cast("string").alias("Testing Standard Year"), F.when(i % 10 == 0, "Computational Method").otherwise("Laboratory Method").alias("Evidence"),
    )
    return cleaning.clean_labels(raw, cleaning.default_names(spark), cleaning.limit_table(spark, {"ciprofloxacin": (60.0, 120.0), "ampicillin": (80.0, 90.0)}))


@query(
    "clean_labels",
    f"""WITH {_RAW_SQL}, h AS (SELECT *, max(rederived IS NOT NULL) OVER w AS has, count(*) OVER w AS n_all FROM r WINDOW w AS (PARTITION BY user_id, drug)),
c AS (SELECT *, CASE WHEN has THEN rederived ELSE submitted END AS call FROM h), y AS (SELECT *, max(year) OVER (PARTITION BY user_id, drug) AS last FROM c WHERE call IS NOT NULL),
v AS (SELECT user_id, drug, sum(call) AS n1, count(*) AS n, bool_or(has) AS has, max(n_all) AS n_all, max(last) AS year FROM y WHERE year = last GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS genome_id, drug AS antibiotic, CAST(n1 * 2 > n AS INT) AS label, CASE WHEN has THEN 'rederived' ELSE 'submitted' END AS label_source, 'EUCAST' AS testing_standard, year AS testing_standard_year, n_all AS n_source_rows FROM v WHERE n1 * 2 <> n""",
)
def clean_labels(spark, d):
    return _job(spark, d).labels


@query(
    "clean_labels_audit",
    f"""WITH {_RAW_SQL} SELECT '2' AS section, CASE WHEN phenotype = '' THEN '(empty)' ELSE phenotype END AS value, count(*) AS rows FROM r GROUP BY ALL
UNION ALL SELECT '3', CASE WHEN mic_like THEN 'MIC-like' ELSE 'Disk diffusion' END, count(*) FROM r GROUP BY ALL UNION ALL SELECT '6', trim(lower(name)), count(*) FROM e WHERE lab GROUP BY ALL""",
)
def clean_labels_audit(spark, d):
    parts = [(name[0], df) for name, df in cleaning.audit(_job(spark, d)) if name[0] in "236" and not name.startswith("10")]
    out = None
    for section, df in parts:
        one = df.select(F.lit(section).alias("section"), F.col(df.columns[0]).alias("value"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "rank_groups",
    f"""WITH {SCORED_SQL}, per AS (SELECT lang, source, count(*) FILTER (y = 1) AS r, count(*) FILTER (y = 0) AS s, count(DISTINCT doc_id) AS e FROM scored GROUP BY ALL),
g AS (SELECT lang, list(source ORDER BY e DESC, source) FILTER (r >= 2 AND s >= 2 AND e >= 5) AS good FROM per GROUP BY lang), n AS (SELECT lang, count(DISTINCT doc_id) AS n_entities FROM scored GROUP BY lang)
SELECT lang, CAST(coalesce(len(good), 0) AS INT) AS n_good, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 999 END AS priority_rank, CAST(greatest(50 - n_entities, n_entities - 100, 0) AS BIGINT) AS size_penalty, n_entities, coalesce(array_to_string(good, ','), '') AS good FROM g JOIN n USING (lang)""",
)
def rank_groups(spark, d):
    return labels.rank_groups(scored(spark, d), "lang", "source", "doc_id", "y", ["de", "en"], 2, 5, (50, 100)).withColumn("good", F.array_join("good", ",")).filter("true")


@query("identifier_text", "SELECT part.p_partkey, CAST(p_partkey AS VARCHAR) || '.' || lpad(CAST(p_size * 10 AS VARCHAR), 3, '0') AS id FROM part")
def identifier_text(spark, d):
    raw = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit("."), F.lpad((F.col("p_size") * 10).cast("string"), 3, "0"), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", N.identifier(raw).alias("id"))


@query("drug_aliases", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'trimethoprim-sulfamethoxazole' WHEN 1 THEN 'ciprofloxacin' WHEN 2 THEN 'trimethoprim-sulfamethoxazole' END AS drug FROM part")
def drug_aliases(spark, d):
    m = F.col("p_size") % 4
    name = F.when(m == 0, " SXT ").when(m == 1, "Ciprofloxacin").when(m == 2, "trimethoprim/sulfamethoxazole").otherwise("snake oil")
    return table(spark, d, "part").select("p_partkey", evidence.resolve_drug(name).alias("drug"))


@query("first_ids", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events ORDER BY 1 LIMIT 25")
def first_ids(spark, d):
    return readers.first_ids(table(spark, d, "events"), "user_id", 25)


# ---------------------------------------------------------------- sequences and gates


@query(
    "base_formats",
    """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars * 1009 ELSE n_chars END AS n FROM documents), r AS (SELECT *, (n + 50) // 100 AS t, (n + 5000) // 10000 AS h FROM b)
SELECT doc_id, CASE WHEN n >= 1000000 THEN (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || ' Mbp' WHEN n >= 1000 THEN (t // 10) || '.' || (t % 10) || ' kbp' ELSE n || ' bp' END AS bases FROM r""",
)
def base_formats(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.format_bases(F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") * 1009).otherwise(F.col("n_chars"))).alias("bases"))


@query(
    "clean_kmers",
    """WITH s AS (SELECT p_partkey, upper(regexp_replace(p_type || p_name, '[^A-Za-z]', '', 'g')) AS s FROM part), k AS (SELECT DISTINCT p_partkey, substr(s, i, 3) AS k FROM s, unnest(range(1, length(s) - 1)) t(i))
SELECT p_partkey, count(k) FILTER (regexp_matches(k, '^[ACGT]+$')) AS n FROM s LEFT JOIN k USING (p_partkey) GROUP BY p_partkey""",
)
def clean_kmers(spark, d):
    s = F.regexp_replace(F.concat("p_type", "p_name"), "[^A-Za-z]", "")
    return table(spark, d, "part").select("p_partkey", F.size(Q.clean_kmers(s, 3)).cast("long").alias("n"))


@query("fasta_summary", "SELECT doc_id, CAST(1 AS BIGINT) AS records, CAST(length(regexp_replace(s, '[Nn]', '', 'g')) AS BIGINT) AS bases, length(s) >= 20 AS ok FROM (SELECT doc_id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS s FROM documents)")
def fasta_summary(spark, d):
    seq = F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", ""))
    one = table(spark, d, "documents").select("doc_id", readers.fasta_summary(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), seq, F.lit("\n"))).alias("x"))
    return one.select("doc_id", F.col("x.records").cast("long").alias("records"), F.col("x.bases").cast("long").alias("bases"), "x.ok")


_HITS_SQL = """h AS (SELECT l_suppkey AS g, CASE l_partkey % 400 WHEN 0 THEN 'gyrA_S' WHEN 1 THEN 'parC_S' WHEN 2 THEN 'gyrB' WHEN 3 THEN 'gyrA_D' ELSE 'bla' END || CAST(l_linenumber AS VARCHAR) AS sym,
  CASE l_quantity % 3 WHEN 0 THEN 'x [WILDTYPE]' WHEN 1 THEN 'x [UNKNOWN]' ELSE 'x' END AS name FROM lineitem),
ev AS (SELECT g, CASE WHEN sym LIKE 'gyrA_%' THEN 'gyrA' ELSE 'parC' END AS locus, coalesce(list_sort(list(DISTINCT sym) FILTER (NOT contains(name, '['))), []) AS mutation,
  coalesce(list_sort(list(DISTINCT sym) FILTER (contains(name, '[WILDTYPE]'))), []) AS wt, coalesce(list_sort(list(DISTINCT sym) FILTER (contains(name, '[UNKNOWN]') AND NOT contains(name, '[WILDTYPE]'))), []) AS unknown
  FROM h WHERE sym LIKE 'gyrA#_%' ESCAPE '#' OR sym LIKE 'parC#_%' ESCAPE '#' GROUP BY ALL),
sh AS (SELECT s_suppkey AS g, locus, round((s_suppkey % 10) / 9.0, 4) AS share FROM supplier, (VALUES ('gyrA'), ('parC')) t(locus) WHERE s_suppkey % 6 <> 0),
sc AS (SELECT s_suppkey AS g FROM supplier WHERE s_suppkey % 2 = 0)"""


def _gate_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(genomes, evidence, screened, shares): lots as hits of a screen."""
    m, q = F.col("l_partkey") % 400, F.col("l_quantity") % 3
    l = table(spark, d, "lineitem")
    stem = F.when(m == 0, "gyrA_S").when(m == 1, "parC_S").when(m == 2, "gyrB").when(m == 3, "gyrA_D").otherwise("bla")
    hits = l.select(F.col("l_suppkey").alias("g"), F.concat(stem, F.col("l_linenumber").cast("string")).alias("sym"), F.when(q == 0, "x [WILDTYPE]").when(q == 1, "x [UNKNOWN]").otherwise("x").alias("name"), F.lit("POINT").alias("subtype"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("g"))
    shares = s.filter("g % 6 != 0").select("g", F.explode(F.array(F.lit("gyrA"), F.lit("parC"))).alias("locus"), F.round((F.col("g") % 10) / 9.0, 4).alias("share"))
    return s, gates.locus_evidence(hits, "g", "sym", "name", "subtype", ["gyrA", "parC"]), s.filter("g % 2 = 0"), shares


@query("locus_evidence", f"WITH {_HITS_SQL} SELECT g, locus, array_to_string(mutation, ',') AS mutation, array_to_string(wt, ',') AS wt, array_to_string(unknown, ',') AS unknown FROM ev")
def locus_evidence(spark, d):
    e = _gate_tables(spark, d)[1]
    return e.select("g", "locus", *[F.array_join(c, ",").alias(c) for c in ("mutation", "wt", "unknown")])


@query(
    "gate_status",
    f"""WITH {_HITS_SQL}, f AS (SELECT s_suppkey AS g, locus FROM supplier, (VALUES ('gyrA'), ('parC')) t(locus)),
j AS (SELECT f.g, f.locus, ev.locus IS NOT NULL OR (sc.g IS NULL AND coalesce(sh.share >= 0.75, false)) AS seen FROM f LEFT JOIN ev USING (g, locus) LEFT JOIN sc ON sc.g = f.g LEFT JOIN sh ON sh.g = f.g AND sh.locus = f.locus)
SELECT g, CASE WHEN bool_and(seen) THEN 'pass' ELSE 'not_callable' END AS status, coalesce(string_agg(locus, ',' ORDER BY locus) FILTER (NOT seen), '') AS missing FROM j GROUP BY g""",
)
def gate_status(spark, d):
    s, e, screened, shares = _gate_tables(spark, d)
    return gates.gate_status(s, "g", ["gyrA", "parC"], e, screened, shares).withColumn("missing", F.array_join("missing", ","))


@query(
    "demo_callability",
    f"""WITH {_HITS_SQL}, f AS (SELECT s_suppkey AS g, locus FROM supplier, (VALUES ('gyrA'), ('parC')) t(locus))
SELECT f.g, f.locus, CASE WHEN len(ev.mutation) > 0 THEN 'mutation_present' WHEN sh.share IS NULL THEN 'unknown' WHEN sh.share >= 0.3 THEN 'wild_type_intact' ELSE 'not_called' END AS status FROM f LEFT JOIN ev USING (g, locus) LEFT JOIN sh ON sh.g = f.g AND sh.locus = f.locus""",
)
def demo_callability(spark, d):
    s, e, _, shares = _gate_tables(spark, d)
    frame = s.withColumn("locus", F.explode(F.array(F.lit("gyrA"), F.lit("parC"))))
    return gates.callability(frame, e, shares, "g").select("g", "locus", "status")


@query("assembly_gate", "SELECT doc_id, sum(length(line)) >= 800 AND count(*) <= 800 AS ok FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def assembly_gate(spark, d):
    """The looser gate: long enough, and not in too many pieces."""
    c = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return gates.assembly_qc(c, "doc_id", F.length("line"), low=800, high=None, most=gates.K.QC_CONTIGS_LOOSE).select("doc_id", "ok")


# ---------------------------------------------------------------- texts and documents


@query("evidence_class", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'known_marker' WHEN l_linestatus = 'O' OR l_returnflag <> 'N' THEN 'statistical_association' ELSE 'no_known_signal' END AS class FROM lineitem")
def evidence_class(spark, d):
    verdict = F.when(F.col("l_returnflag") == "N", S.WORK).otherwise(S.FAIL)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.evidence_class(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", verdict).alias("class"))


@query(
    "reason_texts",
    f"""WITH {SCORED_SQL} SELECT doc_id, CASE CAST(distance AS INT) % 4 WHEN 0 THEN 'All target loci were seen in the assembly.' WHEN 1 THEN 'Not callable: no evidence for gyrA, parC.' WHEN 2 THEN 'Not callable: the assembly is not good enough.' ELSE 'No locus is defined for this drug; silence is no evidence.' END AS gate,
  CASE WHEN p < 0.3 THEN 'No call: the drug''s target was not found.' WHEN p < 0.6 THEN 'No call: neither class or both are plausible (P(fail)=' || printf('%.3f', p) || ').' WHEN p < 0.8 THEN 'No call: the genome is too far from all training genomes.' END AS no_call FROM scored""",
)
def reason_texts(spark, d):
    m = F.col("distance").cast("int") % 4
    status = F.when(m == 0, "pass").when(m == 3, "absence_of_evidence").otherwise("not_callable")
    missing = F.when(m == 1, F.array(F.lit("gyrA"), F.lit("parC"))).otherwise(F.array().cast("array<string>"))
    reason = F.when(F.col("p") < 0.3, "missing_drug_target").when(F.col("p") < 0.6, "conformal_band").when(F.col("p") < 0.8, "ani_ood").otherwise("called")
    return scored(spark, d).select("doc_id", S.gate_text(status, missing).alias("gate"), S.no_call_text(reason, F.col("p")).alias("no_call"))


@query(
    "node_labels",
    """SELECT p_partkey, CASE WHEN length(trim(p_type)) <= 16 THEN trim(p_type) ELSE rtrim(substr(trim(p_type), 1, 15)) || '…' END AS label,
  CASE p_size % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'fail' WHEN 3 THEN 'work' ELSE 'nocall' END AS class FROM part""",
)
def node_labels(spark, d):
    m = F.col("p_size") % 5
    status = F.when(m == 0, "failed").when(m == 1, "queued").otherwise("done")
    return table(spark, d, "part").select("p_partkey", S.node_label(F.col("p_type"), 16).alias("label"), S.node_class(status, F.when(m == 2, S.FAIL).when(m == 3, S.WORK).otherwise(S.NO_CALL)).alias("class"))


@query("parent_lookup", "SELECT o_orderkey, o_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def parent_lookup(spark, d):
    parents = table(spark, d, "customer").filter("c_custkey % 3 != 0").select("c_custkey", F.col("c_name").alias("name"))
    return store.with_parent(table(spark, d, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", "c_custkey", ["name"]).select("o_orderkey", "o_custkey", "name")


@query(
    "attach_reports",
    "SELECT c_custkey, max(o_orderkey) AS at, arg_max(o_orderstatus, o_orderkey) AS summary, count(o_orderkey) AS n_reports FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
)
def attach_reports(spark, d):
    reports = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("summary"))
    return store.attach(table(spark, d, "customer").select("c_custkey"), reports, "c_custkey", "at").select("c_custkey", "report.at", "report.summary", "n_reports")


@query("report_history", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey DESC)[1:3], ',') AS history FROM orders GROUP BY o_custkey")
def report_history(spark, d):
    h = store.history(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus"], 3)
    return h.select("o_custkey", F.array_join(F.transform("history", lambda x: x["o_orderkey"].cast("string")), ",").alias("history"))


@query(
    "stand_in_report",
    f"""WITH {SCORED_SQL}, v AS (SELECT source, lang, CASE WHEN p >= 0.7 THEN 'f' WHEN p < 0.4 THEN 'w' ELSE 'n' END AS v FROM scored), g AS (SELECT source, count(*) FILTER (v = 'f') AS f, count(*) FILTER (v = 'w') AS w, count(*) FILTER (v = 'n') AS n, string_agg(DISTINCT CASE WHEN v = 'w' THEN lang END, ', ' ORDER BY CASE WHEN v = 'w' THEN lang END) AS l FROM v GROUP BY source)
SELECT source, f || ' likely to fail, ' || w || ' likely to work, ' || n || ' without a call.' || CASE WHEN w > 0 THEN ' May work: ' || l || '.' ELSE '' END AS summary FROM g""",
)
def stand_in_report(spark, d):
    v = scored(spark, d).withColumn("verdict", F.when(F.col("p") >= 0.7, S.FAIL).when(F.col("p") < 0.4, S.WORK).otherwise(S.NO_CALL))
    return store.stand_in_report(v, "source", "lang", "verdict").select("source", "summary")


@query(
    "hits_and_zero_hits",
    """WITH h AS (SELECT o_custkey, count(*) AS n_hits, count(*) FILTER (o_orderstatus = 'F') AS n_full, count(*) FILTER (o_orderstatus = 'O') AS n_degraded FROM orders GROUP BY ALL)
SELECT c_custkey, coalesce(n_hits, 0) AS n_hits, coalesce(n_full, 0) AS n_full, coalesce(n_degraded, 0) AS n_degraded FROM customer LEFT JOIN h ON c_custkey = o_custkey""",
)
def hits_and_zero_hits(spark, d):
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "full_gene").when(F.col("o_orderstatus") == "O", "degraded").otherwise("unknown").alias("tier"))
    got = features.hits_by_entity(table(spark, d, "customer").select("c_custkey"), hits, "c_custkey", "tier", ["full_gene", "degraded"])
    return got.select("c_custkey", "n_hits", F.col("n_full_gene").alias("n_full"), "n_degraded")


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return counts.windowed(table(spark, d, "events"), "ts", "1 day", "event_type")


@query("annotation_progress", "SELECT count(*) AS done, CAST(200000 AS BIGINT) AS total, round(count(*) / (date_diff('second', min(ts), max(ts)) / 3600.0), 3) AS per_hour, round((200000 - count(*)) / (count(*) / (date_diff('second', min(ts), max(ts)) / 3600.0)), 3) AS hours_left FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def annotation_progress(spark, d):
    return counts.progress(table(spark, d, "events").select(F.date_trunc("second", "ts").alias("ts")), "ts", 200_000)


# ---------------------------------------------------------------- sources and sinks, there and back


@query("labels_csv_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, '' AS note FROM labels")
def labels_csv_round_trip(spark, d):
    path = scratch(spark, "labels-csv")
    writers.sorted_csv(table(spark, d, "labels").select("doc_id", "quality"), path, ["doc_id"])
    return readers.backfill(readers.text_table(spark, path), ["note"])[0]


@query("annotation_tsv_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_type AS class, 'AMR' AS subtype FROM part")
def annotation_tsv_round_trip(spark, d):
    path = scratch(spark, "hits-tsv")
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").cast("string").alias("Gene symbol"), F.col("p_name").alias("Element name"), F.lit("AMR").alias("Subtype"), F.col("p_type").alias("Class"), F.lit("").alias("Subclass"), F.lit("EXACTX").alias("Method"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    hits, _ = readers.checked_hits(spark, path)
    return hits.select(F.col("Element symbol").alias("symbol"), F.col("Class").alias("class"), F.col("Subtype").alias("subtype"))


@query("fasta_round_trip", "SELECT 'c' || CAST(doc_id AS VARCHAR) AS contig, upper(s) AS seq FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents)")
def fasta_round_trip(spark, d):
    path = scratch(spark, "fasta")
    seq = F.regexp_replace("text", "[^A-Za-z]", "")
    lines = F.regexp_replace(seq, "(.{70})", "$1\n")
    table(spark, d, "documents").select(F.concat(F.lit(">c"), F.col("doc_id").cast("string"), F.lit(" prose\n"), lines).alias("value")).write.text(path)
    return readers.fasta(spark, path, "txt").select("contig", "seq")


@query("edge_list_round_trip", "SELECT 'g.' || CAST(l_orderkey AS VARCHAR) AS ref, 'h' || CAST(l_partkey AS VARCHAR) AS query, l_discount * 100 + 0.0 AS ani, l_tax * 1000 + 0.0 AS af_ref, l_quantity * 2 + 0.0 AS af_query FROM lineitem WHERE l_linenumber = 7")
def edge_list_round_trip(spark, d):
    path = scratch(spark, "edges-tsv")
    l = table(spark, d, "lineitem").filter("l_linenumber = 7")
    l.select(
        F.concat(F.lit("/x/g."), F.col("l_orderkey").cast("string"), F.lit(".fna")).alias("Ref_file"), F.concat(F.lit("h"), F.col("l_partkey").cast("string"), F.lit(".fa.gz")).alias("Query_file"),
        (F.col("l_discount") * 100).alias("ANI"), (F.col("l_tax") * 1000).alias("Align_fraction_ref"), (F.col("l_quantity") * 2).alias("Align_fraction_query"),
    ).write.option("header", True).option("sep", "\t").csv(path)
    got = readers.ani_edges(spark, path)
    return got.select("ref", "query", *[(F.col(c) + 0.0).alias(c) for c in ("ani", "af_ref", "af_query")])


@query("splits_json_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS key, CAST(n_regionkey AS BIGINT) AS cluster_id, CASE WHEN n_nationkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM nation")
def splits_json_round_trip(spark, d):
    path = scratch(spark, "splits-json")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("cluster_id"), F.when(F.col("n_nationkey") % 3 == 0, "test").otherwise("train").alias("split"))
    writers.json_document(writers.as_json_map(n, "n_nationkey", ["cluster_id", "split"]), path)
    return readers.json_map(spark, path, "struct<cluster_id:bigint,split:string>")


@query("gate_envelope_round_trip", "SELECT r_name AS drug, n_name AS genome_id, CASE WHEN n_nationkey % 2 = 0 THEN 'pass' ELSE 'not_callable' END AS status FROM nation JOIN region ON n_regionkey = r_regionkey")
def gate_envelope_round_trip(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    s = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("drug"), F.col("n_name").alias("genome_id"), F.when(F.col("n_nationkey") % 2 == 0, "pass").otherwise("not_callable").alias("status"))
    path = scratch(spark, "gates-json")
    nocall.gate_envelope(s).write.json(path)
    return nocall.read_envelope(spark.read.schema("drug string, value string").json(path))


@query("bands_round_trip", "SELECT p_brand AS drug, avg(p_retailprice) / 10000 AS q_s, min(p_size) / 100.0 AS q_r FROM part GROUP BY p_brand")
def bands_round_trip(spark, d):
    b = table(spark, d, "part").groupBy(F.col("p_brand").alias("drug")).agg((F.avg("p_retailprice") / 10000).alias("q_s"), (F.min("p_size") / 100.0).alias("q_r"))
    path = scratch(spark, "bands-json")
    nocall.save_bands(b, path)
    return nocall.load_bands(spark, path).select("drug", "q_s", "q_r")


@query("feature_store_round_trip", "SELECT p_brand, count(DISTINCT p_size) AS n_entities FROM part GROUP BY p_brand")
def feature_store_round_trip(spark, d):
    long = table(spark, d, "part").select("p_size", "p_brand").distinct()
    path = scratch(spark, "features")
    writers.feature_store(long, table(spark, d, "part"), path, "p_size", "p_brand", ["p_type"])
    return readers.feature_store(spark, path)[1]


@query("label_table_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS genome_id, CAST(quality AS INT) AS y FROM labels")
def label_table_round_trip(spark, d):
    path = scratch(spark, "cohort-tsv")
    table(spark, d, "labels").select(F.col("doc_id").alias("genome_id"), F.lit("x").alias("antibiotic"), F.when(F.col("quality") == 1, S.FAIL).otherwise(S.WORK).alias("label")).write.option("header", True).option("sep", "\t").csv(path)
    return readers.label_table(spark, path).select("genome_id", "y")


@query("line_list_round_trip", "SELECT n_name AS value FROM nation WHERE n_nationkey % 2 = 0")
def line_list_round_trip(spark, d):
    path = scratch(spark, "lines")
    table(spark, d, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 1, "# ").otherwise(" "), "n_name", F.lit("\n")).alias("value")).write.text(path)
    return readers.line_list(spark, path)


@query("probability_file", f"WITH {SCORED_SQL} SELECT line AS value FROM (SELECT '# version=v1' AS line UNION ALL SELECT 'doc_id,p,no_call,reason,dist_to_train' UNION ALL SELECT concat_ws(',', doc_id, printf('%.6f', p), CAST(distance > 90 AS INT), CASE WHEN distance > 90 THEN 'ani_ood' ELSE 'called' END, printf('%.2f', distance)) FROM scored)")
def probability_file(spark, d):
    far = F.col("distance") > 90
    s = scored(spark, d).select("doc_id", "p", far.alias("no_call"), F.when(far, "ani_ood").otherwise("called").alias("reason"), "distance")
    return writers.probability_lines(s, "v1", "doc_id")
