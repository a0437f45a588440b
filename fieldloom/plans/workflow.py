"""Gold construction, correction, sampling and agreement over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import rounded
from ..operators import metrics as K
from ..operators import relational as R
from ..operators import workflow as L
from .base import Registry, table

registry = Registry()
query = registry.query

STATUS_SQL = """
SELECT p_name, count(DISTINCT p_type) AS n_dbs, array_to_string(list_sort(list(DISTINCT p_type)), '+') AS covered, count(*) AS n_source_pairs,
  array_to_string(list_sort(list_filter({every}, lambda x: NOT list_contains(list(DISTINCT p_type), x))), '+') AS missing,
  CASE WHEN len(list_filter({every}, lambda x: NOT list_contains(list(DISTINCT p_type), x))) = 0 THEN 'auto' ELSE 'queue' END AS status
FROM part WHERE p_size < 25 GROUP BY p_name"""
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.concept_status(table(spark, sf_dir, "part").filter("p_size < 25"), "p_name", "p_type", TYPES)


@query(STATUS_SQL.format(every=TYPES))
def concept_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status(spark, sf_dir)


@query(f"""
WITH s AS ({STATUS_SQL.format(every=TYPES)}), r AS (SELECT p_name, list(DISTINCT p_type) AS f FROM part WHERE p_size >= 40 GROUP BY p_name)
SELECT p_name, array_to_string(list_sort(list_filter(string_split(missing, '+'), lambda x: NOT list_contains(coalesce(f, []), x))), '+') AS missing
FROM s LEFT JOIN r USING (p_name) WHERE status = 'queue' AND len(list_filter(string_split(missing, '+'), lambda x: NOT list_contains(coalesce(f, []), x))) > 0""")
def structural_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = status(spark, sf_dir).filter("status = 'queue'").select("p_name", "missing")
    resolved = table(spark, sf_dir, "part").filter("p_size >= 40").select("p_name", "p_type")
    return L.queue_resolved(queue, resolved, ["p_name"], "missing", "p_type")


VERDICT_SQL = "CASE doc_id % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN ' unsure ' WHEN 2 THEN '' ELSE lang END"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    verdict = F.when(k == 0, "UNKNOWN").when(k == 1, " unsure ").when(k == 2, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", verdict.alias("verdict"))


@query(f"""SELECT source, CASE WHEN upper(trim(v)) = 'UNKNOWN' THEN 'unknown' WHEN upper(trim(v)) IN ('UNSURE', '') THEN 'unsure' ELSE 'gold' END AS target, count(*) AS n
FROM (SELECT source, {VERDICT_SQL} AS v FROM documents) GROUP BY ALL""")
def adjudication_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.route(verdicts(spark, sf_dir), "verdict").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH n AS (SELECT doc_id % 300 AS k, 'new' AS origin, min(n_chars) AS size FROM documents WHERE doc_id % 5 > 2 GROUP BY ALL)
SELECT doc_id AS k, 'old' AS origin, n_chars AS size FROM documents WHERE doc_id < 100 UNION ALL SELECT * FROM n WHERE k >= 100""")
def merge_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id < 100").select(F.col("doc_id").alias("k"), F.lit("old").alias("origin"), F.col("n_chars").alias("size"))
    new = docs.filter("doc_id % 5 > 2").select((F.col("doc_id") % 300).alias("k"), F.lit("new").alias("origin"), F.col("n_chars").alias("size"))
    return L.merge(old, new, ["k"])


@query("""
SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'fr' ELSE lang END AS lang, 'gold' AS part FROM documents WHERE doc_id % 9 NOT IN (0, 1)
UNION ALL SELECT doc_id, lang, 'unknown' FROM documents WHERE doc_id % 9 = 0""")
def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 9
    new = F.when(k == 0, "UNKNOWN").when(k == 1, "DELETE").when(k == 2, "UNSURE").when(k == 3, "no such concept").when(k == 4, "fr")
    corrections = docs.select("doc_id", new.alias("new")).filter("new IS NOT NULL")
    gold, moved = L.apply_corrections(docs.select("doc_id", "lang"), corrections, "doc_id", "lang", docs.select("lang"))
    return gold.withColumn("part", F.lit("gold")).unionByName(moved.withColumn("part", F.lit("unknown")))


A_SQL = "CASE WHEN doc_id % 13 = 0 THEN 'UNSURE' WHEN quality = 1 THEN 'good' ELSE 'bad' END"
B_SQL = "CASE WHEN doc_id % 7 = 0 THEN 'bad' WHEN doc_id % 17 = 0 THEN '' WHEN quality = 1 THEN 'good' ELSE 'bad' END"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators: deterministic readings of the labels."""
    good = F.when(F.col("quality") == 1, "good").otherwise("bad")
    a = F.when(F.col("doc_id") % 13 == 0, "UNSURE").otherwise(good)
    b = F.when(F.col("doc_id") % 7 == 0, "bad").when(F.col("doc_id") % 17 == 0, "").otherwise(good)
    rows = table(spark, sf_dir, "labels").select("doc_id", a.alias("a"), b.alias("b"), "toxic")
    return rows.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query(f"""
WITH k AS (SELECT a, b FROM (SELECT {A_SQL} AS a, {B_SQL} AS b FROM labels JOIN documents USING (doc_id)) WHERE a NOT IN ('', 'UNSURE') AND b NOT IN ('', 'UNSURE')),
e AS (SELECT sum(x.n * y.n) AS e FROM (SELECT a AS c, count(*) AS n FROM k GROUP BY a) x JOIN (SELECT b AS c, count(*) AS n FROM k GROUP BY b) y USING (c)),
o AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agreed FROM k)
SELECT n, agreed, round((agreed / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM o, e""")
def kappa_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kappa(answers(spark, sf_dir), "a", "b")


@query(f"""SELECT coalesce(lang, 'ALL') AS stratum, count(*) AS n, count(*) FILTER (a = b) AS agreed, round(100 * count(*) FILTER (a = b) / count(*), 4) AS percent
FROM (SELECT lang, {A_SQL} AS a, {B_SQL} AS b FROM labels JOIN documents USING (doc_id)) GROUP BY ROLLUP (lang)""")
def stratum_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("a") == F.col("b")
    return answers(spark, sf_dir).rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agreed")).select(
        F.coalesce("lang", F.lit("ALL")).alias("stratum"), "n", "agreed", rounded(100 * F.col("agreed") / F.col("n"), 4).alias("percent")
    )


@query(f"""SELECT a, b, count(*) AS n, count(*) FILTER (toxic = 1) AS both_against_model FROM (SELECT toxic, {A_SQL} AS a, {B_SQL} AS b FROM labels JOIN documents USING (doc_id)) WHERE a <> b GROUP BY ALL""")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("both_against_model"))


WILSON = "1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))"


@query(f"""
WITH s AS (SELECT lang, count(*) AS drawn, count(*) FILTER (toxic = 1) AS errors FROM labels JOIN documents USING (doc_id) GROUP BY lang),
w AS (SELECT sum(drawn)::DOUBLE AS n, sum(errors / drawn * pop) / sum(pop) AS p FROM s JOIN (SELECT lang, count(*) AS pop FROM documents GROUP BY lang) USING (lang))
SELECT n::BIGINT AS n, round(100 * p, 4) AS rate, round(100 * ((p + 1.96 * 1.96 / (2 * n)) - {WILSON}) / (1 + 1.96 * 1.96 / n), 4) AS low,
  round(100 * ((p + 1.96 * 1.96 / (2 * n)) + {WILSON}) / (1 + 1.96 * 1.96 / n), 4) AS high FROM w""")
def wilson_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = answers(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("toxic") == 1).alias("errors"))
    pop = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("pop"))
    rate = L.weighted_rate(drawn.join(pop, "lang"), "errors", "drawn", "pop")
    low, high = K.wilson(F.col("rate"), F.col("n").cast("double"))
    return rate.select("n", rounded(100 * F.col("rate"), 4).alias("rate"), low.alias("low"), high.alias("high"))


@query("""
WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7-' || doc_id), doc_id) AS draw FROM documents)
SELECT * FROM d WHERE draw <= CASE lang WHEN 'en' THEN 70 WHEN 'fr' THEN 50 WHEN 'de' THEN 30 WHEN 'es' THEN 20 END""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return R.stratified_sample(docs, "lang", "doc_id", {"en": 70, "fr": 50, "de": 30, "es": 20}, "7")


@query("""
SELECT c_mktsegment AS g, b AS batch, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS items FROM
  (SELECT c_mktsegment, c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 40 AS b FROM customer) GROUP BY ALL""")
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").cast("string").alias("k"), "c_custkey")
    return R.batches(rows, ["g"], ["c_custkey"], "k", 40).select("g", "batch", F.array_join("items", ",").alias("items"))


@query("""
SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents
WHERE n_chars >= 500 AND lang NOT IN ('es') AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def worksheet_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter((F.col("n_chars") >= 500) & ~F.col("lang").isin("es"))
    left = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return R.top_per_key(left.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 2**31 - 1, "place")


@query("SELECT label, count(*) AS n FROM (SELECT n_chars // 1000 AS label FROM documents ORDER BY n_chars DESC, doc_id LIMIT 400) GROUP BY label")
def top_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 largest: the evaluation set's own limit."""
    top = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(400)
    return top.groupBy(F.floor(F.col("n_chars") / 1000).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT name, value FROM (SELECT 'documents' AS name, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'labelled', count(*) FROM labels
UNION ALL SELECT 'toxic percent', round(100 * avg(toxic), 4) FROM labels UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents)""")
def constants_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = [
        docs.agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("name", F.lit("documents")),
        labels.agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("name", F.lit("labelled")),
        labels.agg(rounded(100 * F.avg("toxic"), 4).alias("value")).withColumn("name", F.lit("toxic percent")),
        docs.agg(F.countDistinct("source").cast("double").alias("value")).withColumn("name", F.lit("sources")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("""
SELECT t.e AS evidence, count(*) AS n, round(100 * avg(quality), 4) AS recall_1 FROM (SELECT quality, CASE WHEN starts_with(source, 'src1') THEN 'seen' WHEN starts_with(source, 'src2') THEN 'seen' ELSE 'new' END AS e
FROM labels JOIN documents USING (doc_id)) t GROUP BY t.e""")
def contamination_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.col("source").startswith("src1") | F.col("source").startswith("src2")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy(F.when(seen, "seen").otherwise("new").alias("evidence")).agg(F.count(F.lit(1)).alias("n"), rounded(100 * F.avg("quality"), 4).alias("recall_1"))


@query("""
SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def page_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", links.alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


DBS = ["a", "b", "c"]
_DB = "['a', 'b', 'c'][{k} % 3 + 1]"
#: Parsed pairs; in database c a key is the last segment of what the catalogue calls it.
PARSED_SQL = f"SELECT {_DB.format(k='p_partkey')} AS db, CAST(p_partkey AS VARCHAR) AS field_key, 'k' || (p_partkey // 3 % 40) AS concept FROM part"
HELD_SQL = f"""SELECT DISTINCT {_DB.format(k='l_partkey')} AS db, CASE WHEN l_partkey % 3 = 2 THEN 'x|' ELSE '' END || l_partkey AS field_key
  FROM lineitem WHERE l_quantity > 49"""


def _db(key: str) -> Column:
    return F.get(F.array(*map(F.lit, DBS)), (F.col(key) % 3).cast("int"))


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    concept = F.concat(F.lit("k"), (F.floor(F.col("p_partkey") / 3) % 40).cast("string"))
    parsed = table(spark, sf_dir, "part").select(_db("p_partkey").alias("db"), F.col("p_partkey").cast("string").alias("field_key"), concept.alias("concept"))
    held = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_partkey").distinct()
    name = F.concat(F.when(F.col("l_partkey") % 3 == 2, "x|").otherwise(""), F.col("l_partkey").cast("string"))
    return L.verify_pairs(parsed, held.select(_db("l_partkey").alias("db"), name.alias("field_key")), DBS, ["c"])


GOLD_SQL = f"""WITH p AS ({PARSED_SQL}), h AS ({HELD_SQL}), f AS (SELECT p.*, h.field_key AS matched FROM p JOIN h ON p.db = h.db AND h.field_key = CASE WHEN p.db = 'c' THEN 'x|' ELSE '' END || p.field_key),
s AS (SELECT concept, list_sort(list(DISTINCT db)) AS dbs FROM f GROUP BY concept),
g AS (SELECT db, field_key, matched, concept, CASE WHEN len(dbs) = 3 THEN 'auto' ELSE 'queue' END AS status, array_to_string(dbs, '+') AS covered,
  array_to_string(list_filter(['a', 'b', 'c'], lambda x: NOT list_contains(dbs, x)), '+') AS missing FROM f JOIN s USING (concept)
  UNION ALL SELECT p.db, p.field_key, NULL, p.concept, 'missing', NULL, NULL FROM p ANTI JOIN f USING (db, field_key))"""


@query(f"{GOLD_SQL} SELECT * FROM g")
def gold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed pairs verified against the catalogues: automatic, for the queue, or missing."""
    return gold_pairs(spark, sf_dir).select("db", "field_key", "matched", "concept", "status", "covered", "missing")


@query(f"{GOLD_SQL} SELECT DISTINCT unnest(string_split(missing, '+')) AS db, concept FROM g WHERE status = 'queue'")
def concepts_still_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.still_needed(gold_pairs(spark, sf_dir).filter("status = 'queue'"), "concept", "missing")


_LABELS = "CASE WHEN p_size % 5 = 0 THEN p_type ELSE ' ' || upper(p_name) || ' ' END"
IDENTITY_SQL = f"""WITH shared AS (SELECT p_partkey FROM part WHERE lower(trim(p_name)) = lower(trim({_LABELS})) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 20)),
q AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'c' ELSE 'a' END AS db, CASE WHEN p_partkey % 3 = 0 THEN 'b+c' WHEN p_partkey % 3 = 1 THEN 'b' ELSE 'c' END AS missing FROM part),
t AS (SELECT *, db = 'a' AND contains(missing, 'b') AND p_partkey IN (SELECT p_partkey FROM shared) AS hit FROM q)"""


@query(f"""{IDENTITY_SQL} SELECT p_partkey, 'b' AS db, missing, 'resolved' AS part FROM t WHERE hit
UNION ALL SELECT p_partkey, db, CASE WHEN hit THEN 'c' ELSE missing END, CASE WHEN hit THEN 'a+b' ELSE 'a' END FROM t WHERE NOT hit OR missing <> 'b'""")
def resolve_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key with one label in two dictionaries is the same field in both."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    other = F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")))
    shared = L.shared_identifiers(part.select("p_partkey", F.col("p_name").alias("label")), part.select("p_partkey", other.alias("label")), "p_partkey", "label")
    present = table(spark, sf_dir, "lineitem").filter("l_quantity > 20").select(F.col("l_partkey").alias("p_partkey"))
    missing = F.when(k % 3 == 0, "b+c").when(k % 3 == 1, "b").otherwise("c")
    queue = part.select("p_partkey", F.when(k % 4 == 0, "c").otherwise("a").alias("db"), missing.alias("missing"), F.lit("a").alias("covered"))
    resolved, still = L.resolve_by_identity(queue, shared, present, "p_partkey", "a", "b")
    out = resolved.select("p_partkey", "db", "missing", F.lit("resolved").alias("part"))
    return out.unionByName(still.select("p_partkey", "db", "missing", F.col("covered").alias("part")))


@query("""SELECT g, batch, count(*) AS n, CAST(min(k) AS VARCHAR) AS first, CAST(max(k) AS VARCHAR) AS last FROM (SELECT c_mktsegment AS g, c_custkey AS k,
  (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 120 AS batch FROM customer) GROUP BY g, batch""")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worksheets in chunks of 120 rows, and what each holds."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").cast("string").alias("k"), "c_custkey")
    return R.manifest(R.batches(rows, ["g"], ["c_custkey"], "k", 120), ["g"], "batch", "items")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN nullif(trim(p_brand), '') END, nullif(trim(CASE WHEN p_size % 2 = 0 THEN '  ' ELSE p_type END), '')) AS code FROM part""")
def code_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code from the first of the columns that a bridge may name it by."""
    bridge = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise("").alias("m3_code"), F.when(F.col("p_size") % 2 == 0, "  ").otherwise(F.col("p_type")).alias("CODE")
    )
    return bridge.select("p_partkey", R.first_filled(bridge, ["m3_code", "loinc", "CODE"]).alias("code"))
