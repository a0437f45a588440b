"""Catalogues, sketches, many profiles and parity out of states that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.portable import rounded
from ..operators import catalog as C
from ..operators import increments as I
from ..operators import jobs as J
from ..operators import ordered as O
from ..operators import sketches as S
from ..sources import footers, readers, scratch
from .base import Registry, table
from .profiles import CATALOG_SQL, EVENT_SQL, LINE_SQL, event_observations, line_observations

registry = Registry()
query = registry.query


@query(CATALOG_SQL.format(ev=EVENT_SQL, den="ev"))
def incremental_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of events into one folder: the second profiles its own part files only."""
    folder, state = scratch.scratch_path(spark, "loads"), scratch.scratch_path(spark, "state")
    rows = event_observations(spark, sf_dir)
    late = F.pmod(F.xxhash64("t_offset"), F.lit(2)) == 1
    for name, part in (("first", ~late), ("second", late)):
        rows.filter(part).write.parquet(f"{folder}/{name}")
        I.count_new_parts(spark, folder, state, lambda df: df)
    return I.catalog_so_far(spark, state)


SKETCHED_SQL = """SELECT field_key, src_table, count(*) AS n, count(value_num) AS n_numeric, count(DISTINCT stay_key) AS n_exact, true AS count_kept, true AS rank_kept
FROM (({ev}) UNION ALL ({li})) GROUP BY ALL"""


@query(SKETCHED_SQL.format(ev=EVENT_SQL, li=LINE_SQL))
def sketched_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of eight parts, stored and merged, and whether their estimates keep their bounds."""
    rows = event_observations(spark, sf_dir).unionByName(line_observations(spark, sf_dir))
    parts = S.part_sketches(rows.withColumn("part", F.pmod(F.xxhash64("t_offset"), F.lit(8))), [*C.FIELD, "part"], "stay_key", "value_num")
    told = S.estimates(S.merged(scratch.stored(parts, "sketches"), C.FIELD), C.FIELD)
    return S.kept_bounds(told, rows, C.FIELD, "stay_key", "value_num", {"p01": 0.01, "p50": 0.5, "p99": 0.99})


#: Profiles of an observation table by item and unit, by both rates, by drug and route, by
#: levels, by hospital and by day, as they are named in a first survey of a database.
JOBS = [
    J.Job("chart_items", ("l_partkey", "l_returnflag"), "l_quantity", "l_orderkey"),
    J.Job("lab_items", ("l_suppkey", "l_returnflag"), "l_extendedprice", "l_orderkey"),
    J.Job("input_items", ("l_suppkey", "l_returnflag", "l_linestatus"), "l_tax", "l_orderkey"),
    J.Job("output_items", ("l_linenumber", "l_linestatus"), "l_quantity", "l_orderkey"),
    J.Job("procedure_items", ("l_linenumber", "l_returnflag"), "l_shipmode", "l_orderkey"),
    J.Job("prescribed_drugs", ("l_partkey", "l_linestatus", "l_returnflag"), "l_discount", "l_orderkey", limit=80),
    J.Job("nurse_levels", ("l_returnflag", "l_linestatus", "l_linenumber"), "l_extendedprice", "l_orderkey"),
    J.Job("infusions", ("l_suppkey",), "l_quantity", "l_orderkey", "l_quantity > 25"),
    J.Job("custom_labs", ("l_partkey",), "l_quantity", "l_suppkey", "l_returnflag = 'N'", 30),
    J.Job("exam_paths", ("l_linestatus", "l_partkey"), "l_discount", "l_orderkey", limit=50),
]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.concat(F.lit("m"), F.col("l_linenumber"))  # a value that is no number
    return table(spark, sf_dir, "lineitem").withColumn("l_shipmode", mode)


def _job_sql(job: J.Job) -> str:
    keys = ", ".join(job.keys)
    listed = "array_to_string([" + ", ".join(f"CAST({k} AS VARCHAR)" for k in job.keys) + "], '|')"
    value = f"try_cast({job.value} AS DOUBLE)"
    found = f"""SELECT '{job.name}' AS job, {listed} AS key, [{', '.join(f'CAST({k} AS VARCHAR)' for k in job.keys)}] AS ks, count(*) AS n, count(DISTINCT {job.entity}) AS n_entities,
  count({value}) AS n_numeric, count(*) - count({value}) AS n_other, quantile_disc({value}, 0.01) AS p01, quantile_disc({value}, 0.5) AS p50, quantile_disc({value}, 0.99) AS p99
  FROM li WHERE {job.where or 'true'} GROUP BY {keys}"""
    limited = f"SELECT * FROM ({found}) ORDER BY n DESC, ks LIMIT {job.limit}" if job.limit else found
    return f"SELECT * EXCLUDE (ks) FROM ({limited})"


@query("WITH li AS (SELECT *, 'm' || l_linenumber AS l_shipmode FROM lineitem) " + " UNION ALL ".join(map(_job_sql, JOBS)))
def profile_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten profiles of one table, with its own keys, values and limits each, from one read of it."""
    found = J.profiles(_rows(spark, sf_dir), JOBS)
    return found.select("job", F.array_join("keys", "|").alias("key"), "n", "n_entities", "n_numeric", "n_other", "p01", "p50", "p99")


@query("""WITH k AS (SELECT l_partkey, l_returnflag, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50 FROM lineitem GROUP BY ALL)
SELECT CAST(l_partkey AS VARCHAR) AS item, l_returnflag AS unit, p_name AS label, p_type AS category, n, p50, round(n / sum(n) OVER (), 6) AS share FROM k LEFT JOIN part ON l_partkey = p_partkey""")
def profile_with_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by unit with the dictionary's labels: profiled first, joined after."""
    found = J.share_of_job(J.profiles(_rows(spark, sf_dir), JOBS[:1]))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"), F.col("p_name").alias("label"), F.col("p_type").alias("category"))
    keyed = found.select(F.get("keys", F.lit(0)).alias("item"), F.get("keys", F.lit(1)).alias("unit"), "n", "p50", "share")
    return keyed.join(names, "item", "left").select("item", "unit", "label", "category", "n", "p50", "share")


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS n_entities, count(*) FILTER (value IS NOT NULL) AS nn_value, count(*) FILTER (coalesce(event_type, '') <> '') AS nn_event_type,
  count(*) FILTER (coalesce(props, '') <> '') AS nn_props, count(*) FILTER (event_id % 3 = 0) AS nn_third FROM events""")
def wide_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the columns of a wide table are filled."""
    rows = table(spark, sf_dir, "events").withColumn("third", F.when(F.col("event_id") % 3 == 0, "x").otherwise(""))
    return J.filled_cells(rows, ["value", "event_type", "props", "third"], "user_id")


#: Orders are stays: their price tells their days, their status how they ended.
STAYS_SQL = "SELECT *, o_totalprice / 40000 AS los, o_orderstatus = 'F' AS died FROM orders"


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns({"los": F.col("o_totalprice") / 40000, "died": F.col("o_orderstatus") == "F"})


def _lengths() -> list[Column]:
    return [F.count_if(F.col("los") >= 1).alias("n_ge_24h"), F.count_if(F.col("los") > 7).alias("n_gt_7d")]


@query(f"""SELECT count(*) AS n_stays, count(*) FILTER (los >= 1) AS n_ge_24h, count(*) FILTER (los > 7) AS n_gt_7d, round(avg(los), 3) AS mean_los, round(quantile_disc(los, 0.5), 3) AS median_los FROM ({STAYS_SQL})""")
def los_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of stays, whose median comes out of counted values."""
    rows = stays(spark, sf_dir)
    cells = rows.groupBy("los").agg(F.count(F.lit(1)).alias("n"))
    median = O.weighted_quantiles(cells.withColumn("one", F.lit(1)), ["one"], "los", "n", {"m": (1, 2)}).select(rounded("m", 3).alias("median_los"))
    return rows.agg(F.count(F.lit(1)).alias("n_stays"), *_lengths(), rounded(F.avg("los"), 3).alias("mean_los")).crossJoin(F.broadcast(median))  # one row


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM ({STAYS_SQL}))
SELECT count(*) AS n_first, count(*) FILTER (los >= 1) AS n_ge_24h, count(*) FILTER (los > 7) AS n_gt_7d, count(*) FILTER (los >= 1 AND died) AS n_ge_24h_died, count(c_custkey) AS n_known
FROM s LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE rn = 1""")
def first_stay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both labels over the first stay of each patient, taken by one partial aggregation."""
    first = F.min_by(F.struct("los", "died"), F.struct("o_orderdate", "o_orderkey")).alias("s")
    rows = stays(spark, sf_dir).groupBy("o_custkey").agg(first).select("o_custkey", "s.*")
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    joined = rows.join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.agg(F.count(F.lit(1)).alias("n_first"), *_lengths(), F.count_if((F.col("los") >= 1) & F.col("died")).alias("n_ge_24h_died"), F.count("c_custkey").alias("n_known"))


@query(f"""SELECT o_orderpriority AS source, count(*) AS n_stays, count(DISTINCT o_custkey) AS n_patients, round(avg(los), 3) AS mean_los, count(*) FILTER (los >= 1) AS n_ge_24h,
  count(*) FILTER (los > 7) AS n_gt_7d FROM ({STAYS_SQL}) GROUP BY 1""")
def stays_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("source")).agg(
        F.count(F.lit(1)).alias("n_stays"), F.countDistinct("o_custkey").alias("n_patients"), rounded(F.avg("los"), 3).alias("mean_los"), *_lengths()
    )


@query(f"""SELECT n_name AS hospital, any_value(r_name) AS region, count(*) AS n_stays, count(DISTINCT o_custkey) AS n_patients, count(*) FILTER (died) AS n_died, count(*) FILTER (los >= 1) AS n_ge_24h,
  count(*) FILTER (los > 7) AS n_gt_7d, count(DISTINCT o_orderpriority) AS n_units FROM ({STAYS_SQL}) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def stays_by_hospital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients are counted before their hospital's name is fetched: the names meet a row for each hospital."""
    of = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    counted = stays(spark, sf_dir).join(of, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n_stays"), F.countDistinct("o_custkey").alias("n_patients"), F.count_if("died").alias("n_died"), *_lengths(), F.countDistinct("o_orderpriority").alias("n_units")
    )
    sites = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = counted.join(sites, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("n_name").alias("hospital"), F.col("r_name").alias("region"), "n_stays", "n_patients", "n_died", "n_ge_24h", "n_gt_7d", "n_units")


@query("""SELECT kind, count(*) AS n, count(DISTINCT source) AS n_sources, sum(n_chars)::BIGINT AS n_chars FROM (
  SELECT 'documents' AS kind, source, n_chars FROM documents UNION ALL SELECT 'pages', regexp_extract(url, '^[a-z]+://([^/]+)', 1), length(html) FROM pages) GROUP BY kind""")
def note_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large each kind of free text is, and from how many sources."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("kind"), "source", F.col("n_chars").cast("long").alias("n_chars"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("kind"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("source"), F.length("html").cast("long").alias("n_chars"))
    return docs.unionByName(pages).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS rows, (SELECT count(o_totalprice) FROM orders) AS told, true AS footers_only
UNION ALL SELECT 'events', (SELECT count(*) FROM events), (SELECT count(value) FROM events), true""")
def footer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and non-null values out of the files' footers."""
    out = None
    for name, column in (("orders", "o_totalprice"), ("events", "value")):
        path = f"{sf_dir}/{name}.parquet"
        told = F.lit(footers.reads_footers_only(spark, path, [column]))
        row = footers.parquet_counts(spark, path, [column]).select(F.lit(name).alias("name"), "rows", F.col(column).alias("told"), told.alias("footers_only"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT count(*) AS rows, 3 AS cols, sum(length(c_name) - length(replace(c_name, '5', ''))) AS breaks FROM customer""")
def quoted_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of CSV files whose quoted texts hold line breaks, quotes and blank lines."""
    path = scratch.scratch_path(spark, "quoted.csv")
    told = F.regexp_replace("c_name", "5", '5 "\n\nx')
    rows = table(spark, sf_dir, "customer").select("c_custkey", told.alias('a "name",\nquoted'), "c_acctbal")
    rows.write.option("escape", '"').csv(path, header=True)
    counted = readers.csv_inventory(spark, path).groupBy("cols").agg(F.sum("rows").alias("rows"))
    lines = spark.read.text(path).agg(F.count_if(F.col("value") == "").alias("breaks"))
    return counted.crossJoin(F.broadcast(lines)).select("rows", F.col("cols").cast("int").alias("cols"), "breaks")  # one row


def _slot(x: str, empty: str) -> str:
    return f"coalesce(nullif(trim(CAST({x} AS VARCHAR)), ''), '{empty}')"


CARD_SQL = " || ".join(
    f"'{before}' || " + (_slot(slot, empty) if slot else f"'{empty}'")
    for (before, name, empty), slot in zip(
        N.CARD_TEMPLATE,
        ["p_name", None, "src_table", "p_type", "dtype_inferred", "unit_observed", "p01", "p50", "p99", "n_rows // n_keys", "CAST(floor(100 * missing_rate) AS BIGINT)"],
        strict=True,
    )
)


@query(f"SELECT field_key, {CARD_SQL} AS card, false AS leaks FROM ({CATALOG_SQL.format(ev=LINE_SQL, den='ev')}) LEFT JOIN part ON field_key = CAST(p_partkey AS VARCHAR)")
def template_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of eleven slots out of a catalogue and its dictionary; the key is in none."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("field_key"), F.col("p_name").alias("label"), F.col("p_type").alias("category"))
    known = C.with_dictionary(C.field_catalog(line_observations(spark, sf_dir)), part)
    slots = {s: F.col(s) for s in ("label", "src_table", "category", "p01", "p50", "p99")}
    slots |= {"obs_per_key": F.floor(F.col("n_rows") / F.col("n_keys")), "missing_rate": F.floor(100 * F.col("missing_rate"))}
    card = N.template_card(slots | {"dtype": F.col("dtype_inferred"), "unit": F.col("unit_observed")})
    return known.select("field_key", card.alias("card"), N.leaks_key(card).alias("leaks"))


TEMPLATE = "Map each source column to the targets that mean the same.\nSources:\n{{source_columns}}\nTargets:\n{{target_columns}}\nAnswer in JSON."


@query(f"""WITH l AS (SELECT p_partkey // 40 AS batch, string_agg(p_brand || '.' || p_name || ' -- category ' || p_type || '; median ' || p_size, chr(10) ORDER BY p_partkey) AS s FROM part GROUP BY 1),
t AS (SELECT string_agg('concept_group.' || p_type || ' -- ' || n || ' candidate concepts', chr(10) ORDER BY p_type) AS t FROM (SELECT p_type, count(DISTINCT p_name) AS n FROM part GROUP BY p_type))
SELECT batch, substr(sha256(replace(replace('{TEMPLATE}', '{{{{source_columns}}}}', s), '{{{{target_columns}}}}', t)), 1, 16) AS sha FROM l, t""")
def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each forty fields: their lines, and the groups of concepts with their sizes."""
    part = table(spark, sf_dir, "part")
    line = N.field_line(F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.lit(None), F.lit(""), F.col("p_size"))
    lined = part.select("p_partkey", F.floor(F.col("p_partkey") / 40).alias("batch"), line.alias("line"))
    batches = lined.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]).alias("sources"))
    groups = part.groupBy("p_type").agg(F.countDistinct("p_name").alias("n"))
    told = F.concat(F.lit("concept_group."), F.col("p_type"), F.lit(" -- "), F.col("n").cast("string"), F.lit(" candidate concepts"))
    targets = groups.select(told.alias("line")).agg(F.sort_array(F.collect_list("line")).alias("targets"))  # one row: a catalogue's groups
    prompt = N.prompt(TEMPLATE, F.col("sources"), F.col("targets"))
    return batches.crossJoin(F.broadcast(targets)).select("batch", F.substring(F.sha2(prompt, 256), 1, 16).alias("sha"))
