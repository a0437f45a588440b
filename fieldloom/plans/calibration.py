"""Lookups with fallbacks, concept cards, calibrations and ceilings over the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.portable import crc_split_of, rounded
from ..operators import metrics as K
from ..operators import ordered as O
from ..operators import relational as R
from .base import Registry, table
from .matching import AUROC_SQL, SCORES_SQL, labelled, top
from .matching import LABELLED_SQL as LABELLED

registry = Registry()
query = registry.query


@query("""
WITH alt AS (SELECT p_partkey, o, a FROM (SELECT p_partkey, unnest([0, 1, 2]) AS o, unnest([p_name || '!', p_name, list_last(string_split(p_name, ' '))]) AS a FROM part)),
cat AS (SELECT p_name AS a, min(p_partkey) AS target FROM part WHERE p_size < 10 GROUP BY p_name)
SELECT p_partkey, target, CAST(o AS BIGINT) AS way FROM (SELECT p_partkey, target, o, row_number() OVER (PARTITION BY p_partkey ORDER BY o) AS r FROM alt JOIN cat USING (a)) WHERE r = 1""")
def name_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several spellings of a field that the catalogue knows."""
    part = table(spark, sf_dir, "part")
    ways = F.array(F.concat("p_name", F.lit("!")), F.col("p_name"), F.substring_index("p_name", " ", -1))
    spelt = part.select("p_partkey", F.posexplode(ways).alias("way", "a"))
    catalogue = part.filter("p_size < 10").groupBy(F.col("p_name").alias("a")).agg(F.min("p_partkey").alias("target"))
    return R.keep_first(spelt.join(catalogue, "a"), ["p_partkey"], ["way"]).select("p_partkey", "target", F.col("way").cast("long").alias("way"))


@query("""
SELECT p.p_partkey, coalesce(a.n, b.n, 0) AS n, CASE WHEN a.n IS NOT NULL THEN 'qualified' WHEN b.n IS NOT NULL THEN 'plain' ELSE 'none' END AS way FROM part p
LEFT JOIN (SELECT p_brand || '.' || p_name AS k, count(*) AS n FROM part WHERE p_size > 45 GROUP BY 1) a ON a.k = p.p_brand || '.' || p.p_name
LEFT JOIN (SELECT p_name AS k, count(*) AS n FROM part WHERE p_size > 48 GROUP BY 1) b ON b.k = p.p_name""")
def coalesced_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the qualified key, else the plain one."""
    part = table(spark, sf_dir, "part")
    qualified = F.concat_ws(".", "p_brand", "p_name")
    a = part.filter("p_size > 45").groupBy(qualified.alias("ka")).agg(F.count(F.lit(1)).alias("na"))
    b = part.filter("p_size > 48").groupBy(F.col("p_name").alias("kb")).agg(F.count(F.lit(1)).alias("nb"))
    joined = part.join(a, qualified == F.col("ka"), "left").join(b, F.col("p_name") == F.col("kb"), "left")
    way = F.when(F.col("na").isNotNull(), "qualified").when(F.col("nb").isNotNull(), "plain").otherwise("none")
    return joined.select("p_partkey", F.coalesce("na", "nb", F.lit(0)).alias("n"), way.alias("way"))


@query("""
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM r WHERE i % greatest(1, n // 200) = 0 UNION ALL SELECT NULL, -1e9""")
def subsampled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-th of the sorted scores, and an end point: the curve's thresholds."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    total = orders.agg(F.count(F.lit(1)).alias("n"))
    placed = O.running(orders, "o_totalprice", {"i": F.lit(1)}, "o_orderkey", descending=True).withColumn("i", F.col("i") - 1)
    picked = placed.crossJoin(F.broadcast(total)).filter(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / 200)) == 0)  # one row
    end = spark.range(1).select(F.lit(None).cast("long").alias("o_orderkey"), F.lit(-1e9).alias("o_totalprice"))
    return picked.select("o_orderkey", "o_totalprice").unionByName(end)


#: CRC-32 of an ASCII name: each byte, then each of its bits.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""


@query(f"SELECT p_partkey, CASE WHEN {CRC_SQL} % 10 < 7 THEN 'train' WHEN {CRC_SQL} % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM part")
def crc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field split by the names' CRC-32."""
    return table(spark, sf_dir, "part").select("p_partkey", crc_split_of(F.col("p_name")).alias("split"))


@query("""
WITH m AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS r FROM part WHERE p_size > 2 GROUP BY p_type, p_brand),
s AS (SELECT p_type, round(median(p_retailprice), 4) AS median FROM part WHERE p_size > 2 GROUP BY p_type)
SELECT c AS concept, coalesce('name: ' || c || '; unit: ' || p_brand || '; median: ' || median, 'name: ' || c) AS card, median FROM
(SELECT DISTINCT p_type AS c FROM part UNION SELECT 'NEVER SEEN') LEFT JOIN s ON s.p_type = c LEFT JOIN m ON m.p_type = c AND r = 1""")
def concept_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and median of a concept's fields; the name alone where it has none."""
    part = table(spark, sf_dir, "part")
    known = part.filter("p_size > 2")
    unit = R.mode_per_key(known, ["p_type"], "p_brand", "unit")
    stats = known.groupBy("p_type").agg(rounded(F.median("p_retailprice"), 4).alias("median"))
    concepts = part.select("p_type").union(spark.createDataFrame([("NEVER SEEN",)], "p_type string")).distinct()
    joined = concepts.join(unit, "p_type", "left").join(stats, "p_type", "left")
    full = F.concat(F.lit("name: "), F.col("p_type"), F.lit("; unit: "), F.col("unit"), F.lit("; median: "), F.col("median").cast("string"))
    return joined.select(F.col("p_type").alias("concept"), F.coalesce(full, F.concat(F.lit("name: "), F.col("p_type"))).alias("card"), "median")


@query(f"""WITH {SCORES_SQL}, c AS (SELECT DISTINCT round(score, 2) AS theta FROM top WHERE t = 7), f AS (
  SELECT theta, count(*) FILTER (score >= theta AND gold = concept) AS tp, count(*) FILTER (score >= theta AND gold IS DISTINCT FROM concept) AS fp,
    count(gold) - count(*) FILTER (score >= theta AND gold = concept) AS fn FROM top, c WHERE t = 7 GROUP BY theta)
SELECT theta, round(200 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM f ORDER BY f1 DESC, theta LIMIT 1""")
def locked_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation split's best threshold among its own rounded scores."""
    val = top(spark, sf_dir).filter("t = 7").withColumn("predicted", F.col("concept"))
    grid = val.select(rounded("score", 2).alias("theta")).distinct()
    return K.best_threshold(K.calibrate(val, grid))


@query(f"WITH {SCORES_SQL} " + AUROC_SQL.format(keys="", part="", part2="PARTITION BY", group="", rows="SELECT CAST(gold IS NOT NULL AS BIGINT) AS y, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE score END AS x FROM top"))
def openset_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the raw top score; a field without candidates scores -1."""
    raw = F.when(F.col("field_key") % 9 == 0, -1.0).otherwise(F.col("score"))
    return K.auroc(top(spark, sf_dir).select(raw.alias("x"), F.col("gold").isNotNull().cast("long").alias("y")), "x", "y")


@query(f"""SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc
FROM (SELECT y, row_number() OVER (ORDER BY x, doc_id) AS r FROM ({LABELLED}))""")
def transfer_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by position: ties stand in the order of their ids."""
    ranked = O.running(labelled(spark, sf_dir), "x", {"r": F.lit(1)}, "doc_id")
    p, n = F.sum("y"), F.count(F.lit(1)) - F.sum("y")
    return ranked.agg(rounded((F.sum(F.when(F.col("y") == 1, F.col("r"))) - p * (p + 1) / 2) / (p * n), 6).alias("auroc"))


MODELS = {"plain": 1, "half": 2, "third": 3}


@query(f"WITH {SCORES_SQL}, mm AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in MODELS.items()) + """) v(model, step)),
pp AS (SELECT model, t, gold, CASE WHEN vec_id % step = 0 THEN concept END AS told FROM top, mm)
SELECT model, t, count(*) AS n, count(*) FILTER (gold = told) AS tp, round(100 * count(told) / count(*), 4) AS coverage FROM pp GROUP BY model, t""")
def model_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rankers by domain, in one relation."""
    models = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.lit(v).alias("step")) for k, v in MODELS.items()))).alias("m")
    rows = top(spark, sf_dir).select("*", models).withColumn("predicted", F.when(F.col("field_key") % F.col("m.step") == 0, F.col("concept")))
    return K.open_set(rows.withColumn("model", F.col("m.model")), ("model", "t")).select("model", "t", "n", "tp", "coverage")


@query("""
WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)
SELECT source, count(*) AS population, count(*) FILTER (draw <= 5) AS drawn FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY md5('11-' || doc_id), doc_id) AS draw FROM d WHERE r <= 30) GROUP BY source""")
def capped_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest 30 of each stratum, as its population, and 5 draws of them."""
    docs = table(spark, sf_dir, "documents")
    # A task sends thirty rows of a stratum at most; the draws are among those that are left.
    largest = R.bottom_per_key(docs, "source", [F.desc("n_chars"), F.col("doc_id")], F.lit(30), 30).select("source", "doc_id")
    order = F.md5(F.concat(F.lit("11-"), F.col("doc_id").cast("string")))
    draw = F.row_number().over(Window.partitionBy("source").orderBy(order, "doc_id"))
    return largest.withColumn("draw", draw).groupBy("source").agg(F.count(F.lit(1)).alias("population"), F.count_if(F.col("draw") <= 5).alias("drawn"))


@query(f"""WITH {SCORES_SQL}, a AS (SELECT vec_id, gold, CASE WHEN vec_id % 10 = 0 THEN NULL WHEN vec_id % 10 = 1 THEN (gold + 1) % 8 ELSE gold END AS told FROM top)
SELECT count(*) AS n, count(*) FILTER (gold IS NOT DISTINCT FROM told) AS agreed, round(100 * count(*) FILTER (gold = told) / count(gold), 4) AS ceiling FROM a""")
def annotator_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotator as the predictor: the most that a model could be credited with."""
    k = F.col("field_key") % 10
    told = F.when(k == 1, (F.col("gold") + 1) % 8).when(k != 0, F.col("gold"))
    rows = top(spark, sf_dir).withColumn("told", told)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("gold").eqNullSafe(F.col("told"))).alias("agreed"),
        rounded(100 * F.count_if(F.col("gold") == F.col("told")) / F.count("gold"), 4).alias("ceiling"),
    )
