"""Canonical observations, catalogues, cohorts and profiles over the stand-in tables.

``events`` stands for an observation table with native offsets, ``lineitem`` for a
large fact with numeric item ids and for a wide table, ``part`` for its dictionary,
``orders`` and ``customer`` for stays and patients.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import blank_to_null, hash_tenth, rounded, split_of, try_number, years_apart
from ..operators import catalog as C
from ..operators import ordered as O
from ..operators import relational as R
from ..operators import sketches as S
from ..sources import footers
from .base import Registry, table

registry = Registry()
query = registry.query

EVENT_SQL = """
SELECT user_id AS stay_key, event_type AS field_key, CAST(floor(epoch(ts) / 60) AS BIGINT) AS t_offset,
  value AS value_num,
  CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'mmol/L' END AS value_uom,
  'events' AS src_table
FROM events
"""
LINE_SQL = """
SELECT l_orderkey AS stay_key, CAST(l_partkey AS VARCHAR) AS field_key,
  CAST(floor(epoch(l_shipdate) / 60) AS BIGINT) AS t_offset, l_quantity AS value_num,
  nullif(l_returnflag, 'N') AS value_uom, 'lineitem' AS src_table
FROM lineitem
"""
COHORT_SQL = """
SELECT o_orderkey AS stay_key, o_custkey AS pid, los, label_mortality, split FROM (
  SELECT *, CAST(o_totalprice > 200000 AS BIGINT) AS label_mortality, round(o_totalprice / 100000, 4) AS los,
    CASE WHEN t < 7 THEN 'train' WHEN t = 7 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, CAST(('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 7)) AS BIGINT) % 10 AS t,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rk FROM orders)
  JOIN customer ON o_custkey = c_custkey WHERE rk = 1 AND c_acctbal > 0)
"""
CATALOG_SQL = """
WITH ev AS ({ev}), den AS (SELECT count(DISTINCT stay_key) AS s FROM {den}), u AS (
  SELECT field_key, src_table, value_uom AS unit_observed FROM (
    SELECT field_key, src_table, value_uom, row_number() OVER (PARTITION BY field_key, src_table
      ORDER BY count(*) DESC, value_uom) AS r
    FROM ev WHERE value_uom IS NOT NULL GROUP BY field_key, src_table, value_uom) WHERE r = 1
), ag AS (
  SELECT field_key, src_table, count(*) AS n_rows, count(DISTINCT stay_key) AS n_keys, count(value_num) AS n_numeric,
    count(value_uom) AS n_with_uom, round(quantile_disc(value_num, 0.01), 4) AS p01,
    round(quantile_disc(value_num, 0.5), 4) AS p50, round(quantile_disc(value_num, 0.99), 4) AS p99
  FROM ev GROUP BY ALL)
SELECT ag.*, unit_observed, round(n_with_uom / n_rows, 4) AS unit_recovery_rate,
  round(n_numeric / n_rows, 4) AS numeric_rate, round(n_keys / s, 4) AS coverage, round(1 - n_keys / s, 4) AS missing_rate,
  round(n_rows / n_keys, 2) AS obs_per_key,
  CASE WHEN n_numeric / n_rows >= 0.95 THEN 'numeric' WHEN n_numeric / n_rows <= 0.05 THEN 'categorical' ELSE 'mixed' END
    AS dtype_inferred
FROM ag LEFT JOIN u USING (field_key, src_table), den
"""


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 3
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stay_key"),
        F.col("event_type").alias("field_key"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60e6).alias("t_offset"),
        F.col("value").alias("value_num"),
        F.when(k == 0, "mg/dL").when(k == 1, "mmol/L").alias("value_uom"),
        F.lit("events").alias("src_table"),
    )


def line_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stay_key"),
        F.col("l_partkey").cast("string").alias("field_key"),
        F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 60e6).alias("t_offset"),
        F.col("l_quantity").alias("value_num"),
        F.nullif("l_returnflag", F.lit("N")).alias("value_uom"),
        F.lit("lineitem").alias("src_table"),
    )


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer, with labels and the customer's split."""
    first = R.keep_first(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    joined = first.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter("c_acctbal > 0")
    return joined.select(
        F.col("o_orderkey").alias("stay_key"),
        F.col("o_custkey").alias("pid"),
        rounded(F.col("o_totalprice") / 100000, 4).alias("los"),
        (F.col("o_totalprice") > 200000).cast("long").alias("label_mortality"),
        split_of(F.col("o_custkey").cast("string")).alias("split"),
    )


@query(EVENT_SQL)
def canonical_long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_observations(spark, sf_dir)


@query("""
SELECT l_orderkey AS stay_key, concat_ws('|', p_brand, p_type, p_name) AS field_key, l_quantity AS value_num,
  CAST(NULL AS VARCHAR) AS value_uom, 'lineitem' AS src_table
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def canonical_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return facts.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("stay_key"),
        F.concat_ws("|", "p_brand", "p_type", "p_name").alias("field_key"),
        F.col("l_quantity").alias("value_num"),
        F.lit(None).cast("string").alias("value_uom"),
        F.lit("lineitem").alias("src_table"),
    )


WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""
SELECT field_key, count(*) AS n, round(sum(value_num), 4) AS total, count(DISTINCT l_orderkey) AS n_keys FROM (
  SELECT l_orderkey, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS field_key,
    unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value_num FROM lineitem)
WHERE value_num IS NOT NULL GROUP BY field_key""")
def canonical_wide_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = R.unpivot(table(spark, sf_dir, "lineitem"), ["l_orderkey"], WIDE, "field_key", "value_num")
    return long.groupBy("field_key").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("value_num"), 4).alias("total"), F.countDistinct("l_orderkey").alias("n_keys")
    )


@query(f"SELECT src_table, count(*) AS n, count(value_uom) AS n_uom, count(DISTINCT field_key) AS n_fields FROM (({EVENT_SQL}) UNION ALL ({LINE_SQL})) GROUP BY src_table")
def union_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = reduce(DataFrame.unionByName, [event_observations(spark, sf_dir), line_observations(spark, sf_dir)])
    return both.groupBy("src_table").agg(
        F.count(F.lit(1)).alias("n"), F.count("value_uom").alias("n_uom"), F.countDistinct("field_key").alias("n_fields")
    )


#: A part's size as it may be written: a number, with blanks, above a limit, in words, empty, or in powers of ten.
WRITTEN = ["{x}.7", "> {x}", "", "x{x}", "{x}", " {x} ", "{x}e3", "-{x}", None]
_RAW_SQL = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {'NULL' if w is None else repr(w).replace('{x}', chr(39) + ' || p_size || ' + chr(39))}" for i, w in enumerate(WRITTEN)) + " END"


@query(f"""
SELECT p_partkey, raw, CASE WHEN isfinite(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE) END AS number,
  CAST(floor(CASE WHEN isfinite(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE) END) AS BIGINT) AS whole,
  CASE WHEN starts_with(raw, '> ') THEN p_size + 1 ELSE try_cast(raw AS DOUBLE) END::DOUBLE AS age, nullif(trim(raw), '') AS kept
FROM (SELECT *, {_RAW_SQL} AS raw FROM part)""")
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of what is written; text that is none is null, and above a limit is one more."""
    ways = [F.lit(None).cast("string") if w is None else F.concat(*(F.lit(p) if i % 2 == 0 else F.col("p_size").cast("string") for i, p in enumerate(w.replace("{x}", "\0\0").split("\0")))) for w in WRITTEN]
    raw = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*ways), (F.col("p_partkey") % 9).cast("int")).alias("raw"))
    number = try_number(F.col("raw"))
    return raw.select("p_partkey", "raw", number.alias("number"), F.floor(number).alias("whole"), R.age_years(F.col("raw")).alias("age"), blank_to_null(F.col("raw")).alias("kept"))


@query(CATALOG_SQL.format(ev=EVENT_SQL, den="ev"))
def field_catalog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.field_catalog(event_observations(spark, sf_dir))


LINE_CATALOG_SQL = CATALOG_SQL.format(ev=f"SELECT * FROM ({LINE_SQL}) SEMI JOIN coh USING (stay_key)", den="coh").replace(
    "WITH ev", f"WITH coh AS ({COHORT_SQL}), ev", 1
)


@query(f"""
SELECT c.*, p_name AS label, p_type AS dict_category, p_brand AS dict_unit
FROM ({LINE_CATALOG_SQL}) c LEFT JOIN part ON field_key = CAST(p_partkey AS VARCHAR)""")
def field_catalog_lineitem_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("field_key"),
        F.col("p_name").alias("label"),
        F.col("p_type").alias("dict_category"),
        F.col("p_brand").alias("dict_unit"),
    )
    return C.with_dictionary(C.field_catalog(line_observations(spark, sf_dir), cohort(spark, sf_dir)), dictionary)


@query(f"""
SELECT src_table, count(*) AS n_fields, CAST(sum(n_rows) AS BIGINT) AS n_rows,
  count(*) FILTER (unit_observed IS NULL) AS fields_without_unit, round(sum(n_with_uom) / sum(n_rows), 4) AS row_recovery,
  round(avg(unit_recovery_rate), 4) AS mean_field_recovery
FROM (({CATALOG_SQL.format(ev=EVENT_SQL, den="ev")}) UNION ALL ({CATALOG_SQL.format(ev=LINE_SQL, den="ev")})) GROUP BY src_table""")
def unit_recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A field has its table in its key: one catalogue holds the fields of both.
    both = event_observations(spark, sf_dir).unionByName(line_observations(spark, sf_dir))
    return C.unit_recovery(C.field_catalog(both), ["src_table"])


@query("""
SELECT source, n, n_numeric, round(n_numeric / n, 4) AS numeric_rate,
  CASE WHEN n_numeric / n >= 0.95 THEN 'numeric' WHEN n_numeric / n <= 0.05 THEN 'categorical' ELSE 'mixed' END AS dtype
FROM (SELECT source, count(*) AS n, count(try_cast(CASE WHEN doc_id % 3 = 0 THEN lang ELSE CAST(n_chars AS VARCHAR) END AS DOUBLE)) AS n_numeric
  FROM documents GROUP BY source)""")
def dtype_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("n_chars").cast("string"))
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count(try_number(raw)).alias("n_numeric")
    )
    rate = F.col("n_numeric") / F.col("n")
    return counted.withColumns({"numeric_rate": rounded(rate, 4), "dtype": C.dtype_of(rate)})


PASS1_SQL = """
SELECT CAST(l_partkey AS VARCHAR) AS field_key, count(*) AS n, count(l_quantity) AS n_numeric, round(min(l_quantity), 4) AS v_min,
  round(avg(l_quantity), 4) AS v_avg, round(max(l_quantity), 4) AS v_max FROM lineitem GROUP BY l_partkey"""


@query(PASS1_SQL)
def bigtable_pass1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("field_key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("l_quantity").alias("n_numeric"),
        *(rounded(f("l_quantity"), 4).alias(f"v_{n}") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))),
    )


@query(f"""
WITH top AS (SELECT field_key FROM ({PASS1_SQL}) ORDER BY n DESC, field_key LIMIT 50)
SELECT CAST(l_partkey AS VARCHAR) AS field_key, quantile_disc(l_extendedprice, 0.01) AS p01,
  quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.99) AS p99
FROM lineitem SEMI JOIN top ON CAST(l_partkey AS VARCHAR) = field_key GROUP BY l_partkey""")
def bigtable_pass2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the 50 most frequent fields: the limit is the report's feature."""
    top = bigtable_pass1(spark, sf_dir).orderBy(F.desc("n"), "field_key").limit(50).select("field_key")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("field_key"), "l_extendedprice")
    cells = facts.join(top, "field_key", "left_semi").groupBy("field_key", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    return O.weighted_quantiles(cells, ["field_key"], "l_extendedprice", "n", C.QUANTILES)


@query(COHORT_SQL)
def cohort_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir)


@query(f"""
SELECT split, count(*) AS n, CAST(sum(label_mortality) AS BIGINT) AS n_pos, round(avg(label_mortality), 4) AS rate,
  round(min(los), 4) AS los_min, round(median(los), 4) AS los_median, round(max(los), 4) AS los_max FROM ({COHORT_SQL}) GROUP BY split""")
def cohort_label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label_mortality").alias("n_pos"),
        rounded(F.avg("label_mortality"), 4).alias("rate"),
        rounded(F.min("los"), 4).alias("los_min"),
        rounded(F.median("los"), 4).alias("los_median"),
        rounded(F.max("los"), 4).alias("los_max"),
    )


@query("""
SELECT r_name, n_name, count(*) AS n_suppliers, round(sum(s_acctbal), 2) AS balance, count(*) FILTER (s_acctbal < 0) AS n_negative,
  min(s_name) AS any_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def entity_rollup_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(sites, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("n_suppliers"),
        rounded(F.sum("s_acctbal"), 2).alias("balance"),
        F.count_if(F.col("s_acctbal") < 0).alias("n_negative"),
        F.min("s_name").alias("any_name"),
    )


@query("""
SELECT a.p_partkey AS a_key, b.l_partkey AS b_key, lower(trim(a.p_name)) = lower(trim(b.label)) AS label_exact_match
FROM part a JOIN (SELECT DISTINCT l_partkey, CASE WHEN l_partkey % 2 = 0 THEN upper(p_name) ELSE p_type END AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey) b ON a.p_partkey = b.l_partkey""")
def bridge_exact_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    other = used.select("l_partkey", F.when(F.col("l_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_type")).alias("label"))
    same = F.lower(F.trim("p_name")) == F.lower(F.trim("label"))
    return part.join(other, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("a_key"), F.col("l_partkey").alias("b_key"), same.alias("label_exact_match")
    )


@query(f"SELECT field_key, count(*) AS n FROM ({LINE_SQL}) SEMI JOIN ({COHORT_SQL}) c USING (stay_key) GROUP BY field_key")
def semi_join_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_observations(spark, sf_dir).join(cohort(spark, sf_dir), "stay_key", "left_semi")
    return kept.groupBy("field_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def anti_join_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    unlabelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return unlabelled.select("doc_id", "source", "n_chars")


@query("""
SELECT p_partkey, p_name, CASE WHEN p_type <> 'ECONOMY' THEN true ELSE try_cast(p_partkey AS BIGINT) < 1000 END AS early_era
FROM part SEMI JOIN lineitem ON p_partkey = l_partkey WHERE starts_with(p_name, 's') OR starts_with(p_name, 'r')""")
def shared_key_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, used = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_partkey")
    shared = part.join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").filter(F.col("p_name").rlike("^[sr]"))
    era = F.when(F.col("p_type") != "ECONOMY", True).otherwise(F.col("p_partkey") < 1000)
    return shared.select("p_partkey", "p_name", era.alias("early_era"))


@query("""
WITH cat AS (SELECT DISTINCT concat_ws('|', p_brand, p_type, p_name) AS f FROM part),
k AS (SELECT DISTINCT p_name AS k FROM part UNION SELECT DISTINCT concat_ws('|', p_type, p_name) FROM part
  UNION SELECT concat_ws('|', p_brand, p_type, p_name) FROM part WHERE p_partkey % 5 = 0),
h AS (SELECT DISTINCT k, f, CASE WHEN f = k THEN 0 WHEN ends_with(f, '|' || k) THEN 1 ELSE 2 END AS tier
  FROM k JOIN cat ON f = k OR ends_with(f, '|' || k) OR substr(f, strpos(f, '|') + 1) = k)
SELECT k AS key, f AS matched, CAST(tier AS BIGINT) AS tier FROM h JOIN (SELECT k, min(tier) AS tier FROM h GROUP BY k) USING (k, tier)""")
def suffix_tier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    full, two = F.concat_ws("|", "p_brand", "p_type", "p_name"), F.concat_ws("|", "p_type", "p_name")
    catalogue = part.select(full.alias("full"))
    keys = part.select(F.col("p_name").alias("key")).union(part.select(two)).union(part.filter("p_partkey % 5 = 0").select(full))
    return R.tiered_match(keys, catalogue, "key", "full")


@query(f"SELECT field_key, src_table, count(*) AS n, count(value_num) AS n_numeric, true AS count_kept, true AS rank_kept FROM ({LINE_SQL}) GROUP BY ALL")
def approx_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all fields. Their values differ between engines; that they keep their bounds does not."""
    rows = line_observations(spark, sf_dir)
    told = S.estimates(S.part_sketches(rows, C.FIELD, "stay_key", "value_num"), C.FIELD)
    return S.kept_bounds(told, rows, C.FIELD, "stay_key", "value_num", {"p50": 0.5}).drop("n_exact")


@query("""
SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r
  FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1""")
def mode_with_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_per_key(table(spark, sf_dir, "documents"), ["source"], "lang", "lang")


@query("""
SELECT p_type, p_partkey, n FROM (SELECT p_type, p_partkey, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_partkey) AS r
  FROM (SELECT p_type, p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)) WHERE r = 1""")
def argmax_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("l_orderkey").alias("c"))
    part = table(spark, sf_dir, "part").join(counts, F.col("p_partkey") == F.col("l_partkey"), "left")
    rows = part.select("p_type", "p_partkey", F.coalesce("c", F.lit(0)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "p_partkey", "n"))
    return rows.groupBy("p_type").agg(best.alias("b")).select("p_type", "b.p_partkey", "b.n")


@query("""
SELECT p_brand AS code, p_type AS concept, n FROM (SELECT p_brand, p_type, count(*) AS n,
  row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r = 1""")
def vote_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code"), F.col("p_type").alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    return R.keep_first(votes, ["code"], [F.desc("n"), "concept"])


@query("""
SELECT source, array_to_string(list_sort(list(DISTINCT lang)), '+') AS covered,
  array_to_string(list_filter(['de', 'en', 'es', 'fr'], lambda x: NOT list_contains(list(DISTINCT lang), x)), '+') AS missing,
  CASE count(DISTINCT lang) WHEN 4 THEN 'auto' ELSE 'queue' END AS status, count(DISTINCT lang) AS n_covered
FROM documents WHERE n_chars > 3000 GROUP BY source""")
def set_coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.array(*(F.lit(x) for x in ("de", "en", "es", "fr")))
    sets = table(spark, sf_dir, "documents").filter("n_chars > 3000").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("s"))
    return sets.select(
        "source",
        F.array_join("s", "+").alias("covered"),
        F.array_join(F.array_except(every, "s"), "+").alias("missing"),
        F.when(F.size("s") == 4, "auto").otherwise("queue").alias("status"),
        F.size("s").cast("long").alias("n_covered"),
    )


@query("""
WITH f AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS i FROM orders), s AS (SELECT g, count(*) AS n FROM f GROUP BY g),
b AS (SELECT x.g AS a, y.g AS b, count(*) AS n_both FROM f x JOIN f y ON x.i = y.i AND x.g < y.g GROUP BY ALL)
SELECT x.g AS a, y.g AS b, coalesce(n_both, 0) AS n_both, x.n + y.n - coalesce(n_both, 0) AS n_any,
  round(coalesce(n_both, 0) / (x.n + y.n - coalesce(n_both, 0)), 6) AS jaccard
FROM s x JOIN s y ON x.g < y.g LEFT JOIN b ON b.a = x.g AND b.b = y.g""")
def jaccard_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.jaccard_of_sets(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")


@query("""
SELECT c_custkey, t AS tenth, CASE WHEN t < 7 THEN 'train' WHEN t = 7 THEN 'val' ELSE 'test' END AS split
FROM (SELECT c_custkey, CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 7)) AS BIGINT) % 10 AS t FROM customer)""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", hash_tenth(key).alias("tenth"), split_of(key).alias("split"))


PROFILE_SQL = """
SELECT {keys}, count(*) AS n, count(DISTINCT {entity}) AS n_entities, count({value}) AS n_numeric, round(min({value}), 4) AS v_min,
  round(avg({value}), 4) AS v_avg, round(max({value}), 4) AS v_max, round(median({value}), 4) AS v_median FROM {table} GROUP BY {keys}"""


@query(PROFILE_SQL.format(keys="l_returnflag, l_linestatus", entity="l_orderkey", value="l_quantity", table="lineitem"))
def profile_composite_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile_fields(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_orderkey")


@query(PROFILE_SQL.format(keys="event_type", entity="user_id", value="value", table="events"))
def profile_event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile_fields(table(spark, sf_dir, "events"), ["event_type"], "value", "user_id")


@query(PROFILE_SQL.format(keys="o_orderpriority, o_orderstatus", entity="o_custkey", value="o_totalprice", table="orders") + " ORDER BY n DESC, 1, 2 LIMIT 10")
def profile_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-10 report, as the profiled dictionaries are."""
    return R.profile_fields(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", "o_custkey", limit=10)


@query("""
SELECT (SELECT count(*) FROM customer) AS n_patients, (SELECT count(*) FROM orders) AS n_stays,
  (SELECT count(DISTINCT o_custkey) FROM orders) AS n_with_stay, (SELECT count(*) FROM events WHERE value IS NULL) AS n_no_value""")
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar counts side by side; each is one row."""
    counts = [
        table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n_patients")),
        table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n_stays"), F.countDistinct("o_custkey").alias("n_with_stay")),
        table(spark, sf_dir, "events").agg(F.count_if(F.col("value").isNull()).alias("n_no_value")),
    ]
    return reduce(DataFrame.crossJoin, counts)


@query("""
SELECT t, CAST(count(*) AS BIGINT) AS rows, CAST(max(e) AS BIGINT) AS expected_rows, count(*) = max(e) OR t = 'events' AS ok, round(100 * avg(v), 4) AS non_null
FROM (SELECT 'lineitem' AS t, (SELECT count(*) FROM lineitem) AS e, CAST(l_quantity IS NOT NULL AS INT) AS v FROM lineitem
  UNION ALL SELECT 'events', -1, CAST(value IS NOT NULL AS INT) FROM events) GROUP BY t""")
def row_parity_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    def found(name: str, value: str) -> DataFrame:
        counted = footers.parquet_counts(spark, f"{sf_dir}/{name}.parquet", [value])
        return counted.select("rows", rounded(100 * F.col(value) / F.nullif("rows", F.lit(0)), 4).alias("non_null"), F.lit(name).alias("t"))

    counts = found("lineitem", "l_quantity").unionByName(found("events", "value"))
    whole = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("expected_rows")).withColumn("t", F.lit("lineitem"))
    expected = whole.unionByName(spark.createDataFrame([(-1, "events")], "expected_rows long, t string"))
    return R.verify_rows(counts, expected, "t", strict=F.col("t") != "events")


@query("""
SELECT o_orderkey, year(o_orderdate) - 1990 AS boundaries, CAST(rint(epoch(o_orderdate) / 60) AS BIGINT) AS minutes FROM orders""".replace("rint(", "round_even(").replace("/ 60)", "/ 60, 0)"))
def time_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.portable import epoch_minutes

    start = F.lit("1990-12-31").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        years_apart(start, F.col("o_orderdate")).alias("boundaries"),
        epoch_minutes(F.col("o_orderdate").cast("timestamp")).alias("minutes"),
    )


HOURLY_SQL = f"""
WITH z AS (SELECT *, min(t_offset) OVER (PARTITION BY stay_key) AS t0 FROM ({EVENT_SQL}) WHERE value_num IS NOT NULL)
SELECT stay_key, field_key, CAST(floor((t_offset - t0) / 60) AS BIGINT) AS hr, count(*) AS n, round(avg(value_num), 6) AS v
FROM z WHERE (t_offset - t0) / 60 < 24 GROUP BY ALL"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per stay, field and hour since the stay's first number, for one day."""
    numbers = event_observations(spark, sf_dir).filter("value_num IS NOT NULL")
    zero = numbers.groupBy("stay_key").agg(F.min("t_offset").alias("t0"))
    hr = F.floor((F.col("t_offset") - F.col("t0")) / 60)
    binned = numbers.join(zero, "stay_key").withColumn("hr", hr).filter(F.col("hr").between(0, 23))
    return binned.groupBy("stay_key", "field_key", "hr").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value_num"), 6).alias("v"))


@query(HOURLY_SQL)
def hourly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir)


CHANNELS = ["click", "error", "purchase", "view"]


@query(f"""SELECT stay_key, hr, {", ".join(f"round(avg(v) FILTER (field_key = '{c}'), 6) AS ch_{c}" for c in CHANNELS)}
FROM ({HOURLY_SQL}) GROUP BY stay_key, hr""")
def channel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = hourly(spark, sf_dir).groupBy("stay_key", "hr").pivot("field_key", CHANNELS).agg(rounded(F.avg("v"), 6))
    return wide.withColumnsRenamed({c: f"ch_{c}" for c in CHANNELS})


@query(f"""
WITH h AS ({HOURLY_SQL}), s AS (SELECT field_key, avg(v) AS m, stddev_pop(v) AS sd FROM h
  WHERE CAST(('0x' || substr(md5(CAST(stay_key AS VARCHAR)), 1, 7)) AS BIGINT) % 10 < 7 GROUP BY field_key)
SELECT stay_key, hr, field_key, round((v - coalesce(m, 0)) / (CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END), 4) AS z FROM h LEFT JOIN s USING (field_key)""")
def masked_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations from the training stays' means; absent channels are (0, 1)."""
    hours = hourly(spark, sf_dir)
    train = hours.filter(split_of(F.col("stay_key").cast("string")) == "train")
    stats = train.groupBy("field_key").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    sd = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    return hours.join(stats, "field_key", "left").select("stay_key", "hr", "field_key", rounded((F.col("v") - F.coalesce("m", F.lit(0.0))) / sd, 4).alias("z"))


@query(f"SELECT field_key, count(*) AS n_hours, round(avg(n), 4) AS per_hour, max(hr) AS last_hour FROM ({HOURLY_SQL}) GROUP BY field_key")
def channel_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).groupBy("field_key").agg(
        F.count(F.lit(1)).alias("n_hours"), rounded(F.avg("n"), 4).alias("per_hour"), F.max("hr").alias("last_hour")
    )


@query("""
SELECT field_key, first_offset FROM (SELECT event_type AS field_key, min(CAST(floor(epoch(ts) / 60) AS BIGINT)) AS first_offset FROM events GROUP BY 1)""")
def offset_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_observations(spark, sf_dir).groupBy("field_key").agg(F.min("t_offset").alias("first_offset"))
