"""Sources and sinks: what is written is read again, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import units as U
from ..functions import vocabulary as V
from ..functions.portable import rounded
from ..sources import readers, scratch, writers
from . import rules as P
from .base import Registry, table

registry = Registry()
query = registry.query


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size % 4 <> 0 THEN p_name || ', \"' || p_size || '\"' END AS told FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, separators and nulls survive a CSV; all columns come back as strings."""
    told = F.when(F.col("p_size") % 4 != 0, F.concat("p_name", F.lit(', "'), "p_size", F.lit('"')))
    path = scratch.scratch_path(spark, "parts.csv")
    writers.write(table(spark, sf_dir, "part").select("p_partkey", "p_name", told.alias("told")), path)
    return readers.csv_strings(spark, path)


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name, 'c_custkey|c_name' AS header, true AS marked FROM customer""")
def marked_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with a byte-order mark, as spreadsheets write them: the mark is no part of a name."""
    path = scratch.scratch_path(spark, "marked.csv")
    writers.write(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(readers.MARK + "c_custkey"), "c_name"), path)
    found = readers.csv_strings(spark, path)
    first = spark.read.format("binaryFile").load(path + "/*.csv").select(F.hex(F.substring("content", 1, 3)).alias("bytes"))
    raw = first.agg(F.max(F.col("bytes") == readers.MARK.encode().hex().upper()).alias("marked"))
    return found.withColumn("header", F.lit("|".join(found.columns))).crossJoin(F.broadcast(raw))  # one row


@query("""SELECT src_table, count(*) AS n, count(DISTINCT field_key) AS n_fields, count(value_num) AS n_numeric, round(sum(value_num), 2) AS total, min(t_offset) AS first, max(t_offset) AS last FROM (
  SELECT 'lineitem' AS src_table, CAST(l_partkey AS VARCHAR) AS field_key, CAST(floor(epoch(l_shipdate) / 60) AS BIGINT) AS t_offset, l_quantity AS value_num FROM lineitem) GROUP BY 1""")
def csv_to_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV of a large table as canonical parquet: strings in, typed observations out, in one pass."""
    path, out = scratch.scratch_path(spark, "raw.csv"), scratch.scratch_path(spark, "canonical")
    writers.write(raw_lines(spark, sf_dir), path)
    canonical(readers.csv_strings(spark, path), out)
    return spark.read.parquet(out).groupBy("src_table").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("field_key").alias("n_fields"), F.count("value_num").alias("n_numeric"),
        rounded(F.sum("value_num"), 2).alias("total"), F.min("t_offset").alias("first"), F.max("t_offset").alias("last"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", F.unix_timestamp("l_shipdate").alias("seconds"))


def canonical(raw: DataFrame, path: str) -> int:
    """Rows written: observations out of string columns; what is no number is null."""
    rows = raw.select(
        F.expr("try_cast(l_orderkey AS bigint)").alias("stay_key"),
        F.col("l_partkey").alias("field_key"),
        F.floor(F.expr("try_cast(seconds AS bigint)") / 60).alias("t_offset"),
        F.expr("try_cast(l_quantity AS double)").alias("value_num"),
        F.nullif("l_returnflag", F.lit("N")).alias("value_uom"),
        F.lit("lineitem").alias("src_table"),
    )
    return writers.write(rows, path)


@query("SELECT l_returnflag, count(*) AS n, sum(l_linenumber) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag")
def typed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.scratch_path(spark, "lines.csv")
    writers.write(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity"), path)
    rows = readers.csv_typed(spark, path, "l_returnflag string, l_linenumber long, l_quantity double")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"), rounded(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT column_name, column_type, ordinal, (SELECT count(*) FROM customer) AS n
FROM (VALUES ('c_custkey', 'bigint', 0), ('c_name', 'string', 1), ('c_acctbal', 'double', 2)) t(column_name, column_type, ordinal)""")
def described_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part files of a folder by a glob, their columns, and their rows."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long"), "c_name", F.col("c_acctbal").cast("double"))
    path = scratch.scratch_path(spark, "customers")
    writers.write(rows, path)
    found = readers.parquet_files(spark, path + "/*.parquet")
    return readers.describe(found).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("n"))))  # one row


@query("SELECT n_name || '.csv' AS relpath, 100 + n_nationkey AS bytes, n_nationkey AS rows, 3 AS cols, 'd' || n_regionkey AS dataset FROM nation")
def tsv_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    listed = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), "n_regionkey"), F.concat("n_name", F.lit(".csv")), key + 100, key, F.lit(3))
    path = scratch.scratch_path(spark, "files.tsv")
    listed.write.csv(path, sep="\t")
    return readers.inventory(spark, path)


@query("""SELECT n_regionkey AS region, count(*) AS n, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file holds one document."""
    nation = table(spark, sf_dir, "nation")
    nested = nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    path = scratch.scratch_path(spark, "regions")
    nested.withColumn("file", F.col("region")).write.partitionBy("file").json(path)
    found = readers.json_documents(spark, path, "region long, names array<string>")
    return found.select("region", F.size("names").cast("long").alias("n"), F.array_join("names", "|").alias("names"))


@query("""SELECT n_regionkey AS region, string_agg('-- ' || n_name, chr(10) ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey""")
def whole_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region, read as one text, its lines included."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list("n_name")), lambda x: F.concat(F.lit("-- "), x)), "\n")
    path = scratch.scratch_path(spark, "statements")
    table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(lines.alias("text")).write.partitionBy("region").text(path)
    region = F.regexp_extract("src_file", r"region=(\d+)/", 1).cast("long")
    return readers.whole_texts(spark, path, "*.txt").select(region.alias("region"), F.rtrim("text", F.lit("\n")).alias("text"))


COLUMNS = ["s_suppkey", "name, quoted", 'say "it"', "s_acctbal"]


@query(f"""SELECT column_name, ordinal, 4 AS cols, (SELECT count(*) FROM supplier) AS rows
FROM (VALUES {', '.join(f'({P.text(c)}, {i})' for i, c in enumerate(COLUMNS))}) t(column_name, ordinal)""")
def csv_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of CSV files, and their headers; a quoted name may hold commas."""
    path = scratch.scratch_path(spark, "suppliers.csv")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit("x"), "s_acctbal").toDF(*COLUMNS)
    rows.write.option("escape", '"').csv(path, header=True)
    counted = readers.csv_inventory(spark, path).groupBy("cols").agg(F.sum("rows").alias("rows"))
    names = readers.headers(spark, path).select("ordinal", "column_name").distinct()
    return names.crossJoin(F.broadcast(counted))  # one row


@query("SELECT r_regionkey, r_name FROM region")
def present_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two sources the one that is there."""
    found = readers.if_there(spark, [f"{sf_dir}/region.parquet", scratch.scratch_path(spark, "nowhere")])
    return found.select("r_regionkey", "r_name")


@query("""SELECT p_type AS dimension, count(*) AS n, count(*) FILTER (p_size % 4 <> 0) AS n_factors
FROM (SELECT DISTINCT p_type, p_brand, p_size FROM part) GROUP BY p_type""")
def unit_table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A users' unit table, found at the second of two places."""
    path = scratch.scratch_path(spark, "units.csv")
    factor = F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("string")).otherwise("")
    made = table(spark, sf_dir, "part").select(F.lower("p_brand"), F.concat(F.lit("u"), F.col("p_size")), factor, F.lit(""), "p_type", F.lit(""), F.lit("a")).distinct()
    writers.write(made.toDF(*(c.split()[0] for c in U.TABLE_SCHEMA.split(", "))), path)
    rows = U.load_table(spark, fallbacks=(scratch.scratch_path(spark, "nowhere"), path))
    return rows.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count("factor").alias("n_factors"))


@query(f"""SELECT 'dimension' AS name, {len(set(V.UNIT_DIMENSIONS.values())) + 1} AS size UNION ALL SELECT 'type', count(DISTINCT p_type) + 1 FROM part""")
def saved_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabularies saved as JSON and loaded again, with their sizes."""
    dimensions = spark.createDataFrame([("dimension", d) for d in V.UNIT_DIMENSIONS.values()], "name string, entry string")
    types = table(spark, sf_dir, "part").select(F.lit("type").alias("name"), F.col("p_type").alias("entry")).distinct()
    path = scratch.scratch_path(spark, "vocabularies")
    dimensions.unionByName(types).write.json(path)
    return E.vocabulary_sizes(spark.read.schema("name string, entry string").json(path))


@query("""SELECT 'bad' AS name, NULL::BIGINT AS rows, true AS failed UNION ALL SELECT 'parts', count(*), false FROM part
UNION ALL SELECT 'orders.csv', count(*), false FROM orders""")
def isolated_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's rows are counted as it writes; one that fails stops no other."""
    jobs = {
        "bad": lambda: table(spark, sf_dir, "part").select("no_such_column"),
        "parts": lambda: table(spark, sf_dir, "part").select("p_partkey", "p_name"),
        "orders.csv": lambda: table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
    }
    done = writers.run_jobs(spark, jobs, scratch.scratch_path(spark, "jobs"))
    return done.select("name", "rows", F.col("error").isNotNull().alias("failed"))


@query("SELECT count(*) AS n, 1 AS made FROM supplier")
def resumed_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished step is read, not made again."""
    made, path = [], scratch.scratch_path(spark, "step")

    def make() -> DataFrame:
        made.append(1)
        return table(spark, sf_dir, "supplier")

    writers.step(spark, path, make)
    return writers.step(spark, path, make).agg(F.count(F.lit(1)).alias("n")).withColumn("made", F.lit(len(made)))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def temp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch.temp_table(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "fieldloom_customers")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM fieldloom_customers GROUP BY c_mktsegment")


@query("""SELECT o_orderkey AS k, 'old' AS origin FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0""")
def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV set rewritten as old rows and new ones whose key was not there."""
    orders, path, out = table(spark, sf_dir, "orders"), scratch.scratch_path(spark, "old.csv"), scratch.scratch_path(spark, "merged.csv")
    writers.write(orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("origin")), path)
    old = readers.csv_typed(spark, path, "k long, origin string")
    writers.write(writers.append_merge(old, orders.select(F.col("o_orderkey").alias("k"), F.lit("new").alias("origin")), ["k"]), out)
    return readers.csv_typed(spark, out, "k long, origin string")
