"""Retrieval, gating, abstention and evaluation over embeddings and labelled documents.

Embeddings are fields with a vector; labels 0 to 7 are concepts, 8 and 9 unknown. The
split by digest gives the training fields whose means are the concepts' prototypes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import hash_tenth, rounded
from ..operators import matching as M
from ..operators import metrics as K
from ..operators import resampling as S
from ..sources import scratch
from .base import Registry, table

registry = Registry()
query = registry.query

TENTH = "CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 7)) AS BIGINT) % 10"
#: Vectors as doubles, prototypes of unit length, and all scores, as common tables.
SCORES_SQL = f"""
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {TENTH} AS t FROM embeddings),
m AS (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) r(i) WHERE t < 7 AND label < 8 GROUP BY label, i),
p AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
s AS (SELECT vec_id, e.label AS gold, t, p.label AS concept, round(list_dot_product(e.v, p.v)
  / (sqrt(list_dot_product(e.v, e.v)) + 1e-9) / (sqrt(list_dot_product(p.v, p.v)) + 1e-9), 6) AS score FROM e, p WHERE t >= 7),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, concept) AS rank FROM s),
top AS (SELECT vec_id, t, CASE WHEN gold < 8 THEN gold END AS gold, concept, score FROM ranked WHERE rank = 1)
"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("field_key"), F.col("label").cast("long").alias("label"), vector.alias("vector"), hash_tenth(F.col("vec_id").cast("string")).alias("t")
    )


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fields(spark, sf_dir).filter("t < 7 AND label < 8").select(F.col("label").alias("concept"), "vector")
    return M.prototypes(train).select("concept", "vector", "mean", "n_fields", "source")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept, vector): the means that scores divide by their norms, which are not of unit length yet."""
    return concepts(spark, sf_dir).select("concept", F.col("mean").alias("vector"))


def ranking(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    held = fields(spark, sf_dir).filter("t >= 7")
    ranked = M.cosine_topk(held.select("field_key", "vector"), representatives(spark, sf_dir), k)
    return ranked.join(held.select("field_key", "label", "t"), "field_key")


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(F.col("label") < 8, F.col("label"))
    return ranking(spark, sf_dir, 1).select("field_key", "t", gold.alias("gold"), "concept", "score")


@query(f"WITH {SCORES_SQL} SELECT vec_id AS field_key, CAST(concept AS BIGINT) AS concept, score, rank FROM ranked WHERE rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking(spark, sf_dir, 5).select("field_key", "concept", "score", "rank")


@query(f"""WITH {SCORES_SQL}, n AS (SELECT label, count(*) AS n FROM e WHERE t < 7 AND label < 8 GROUP BY label)
SELECT CAST(label AS BIGINT) AS concept, n AS n_fields, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-9), 6) AS first,
  round(v[64] / (sqrt(list_dot_product(v, v)) + 1e-9), 6) AS last, CAST(CASE WHEN n < 3 THEN 2 ELSE 0 END AS BIGINT) AS source FROM p JOIN n USING (label)""")
def class_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts(spark, sf_dir).select(
        "concept", "n_fields", rounded(F.get("vector", 0), 6).alias("first"), rounded(F.get("vector", 63), 6).alias("last"), "source"
    )


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id AS q, v AS w FROM e WHERE vec_id < 5),
s AS (SELECT vec_id, q, i, list_dot_product(v[i:i + 15], w[i:i + 15]) / (sqrt(list_dot_product(v[i:i + 15], v[i:i + 15])) * sqrt(list_dot_product(w[i:i + 15], w[i:i + 15])) + 1e-9) AS c
  FROM e, p, unnest([1, 17, 33, 49]) u(i))
SELECT vec_id AS field_key, q AS concept, round(sum(c), 5) AS s_sem FROM s GROUP BY ALL""")
def slice_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = F.transform(F.sequence(F.lit(1), F.lit(49), F.lit(16)), lambda i: F.slice("vector", i, 16))
    sliced = fields(spark, sf_dir).select("field_key", slices.alias("x"))
    few = sliced.filter("field_key < 5").select(F.col("field_key").alias("concept"), F.col("x").alias("y"))  # five concepts
    return sliced.crossJoin(F.broadcast(few)).select("field_key", "concept", rounded(M.slice_cosine(F.col("x"), F.col("y")), 5).alias("s_sem"))


@query("""
SELECT doc_id AS field_key, item_id AS concept, 1.0::DOUBLE AS score FROM
  (SELECT doc_id, lower(regexp_replace(source, '[^a-zA-Z0-9 ]+', ' ', 'g')) AS n FROM documents)
  JOIN (SELECT p_partkey AS item_id, 'src' || (p_partkey % 40) AS n FROM part WHERE p_partkey < 40) USING (n)""")
def exact_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("field_key"), F.concat(F.lit("Group|"), F.upper("source")).alias("raw_name"))
    wanted = table(spark, sf_dir, "part").filter("p_partkey < 40").select(F.concat(F.lit("src"), F.col("p_partkey") % 40).alias("concept"), "p_partkey")
    return M.exact_names(names, wanted).join(wanted, "concept").select("field_key", F.col("p_partkey").alias("concept"), "score")


@query("""
WITH v AS (SELECT p_brand AS code, p_type AS c, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand, p_type)
SELECT p_partkey AS field_key, c AS concept, 1.0::DOUBLE AS score FROM part JOIN v ON p_brand = code AND r = 1 WHERE p_partkey % 3 <> 0""")
def ontology_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    other = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("field_key"), F.col("p_brand").alias("code"))
    votes = part.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("code"), F.col("p_type").alias("concept"))
    return M.by_codes(other.select("field_key"), other, votes)


@query(f"""WITH {SCORES_SQL} SELECT count(*) AS n_gold, round(100 * avg(CAST(rank <= 1 AS INT)), 4) AS recall_1, round(100 * avg(CAST(rank <= 5 AS INT)), 4) AS recall_5,
  round(100 * avg(CAST(rank <= 10 AS INT)), 4) AS recall_10 FROM ranked WHERE gold < 8 AND concept = gold""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranking(spark, sf_dir).filter("label < 8").groupBy("field_key", F.col("label").alias("gold")).agg(F.min(F.when(F.col("concept") == F.col("label"), F.col("rank"))).alias("gold_rank"))
    return K.recall_at(hits)


PRED_SQL = "SELECT *, CASE WHEN score >= 0.3 THEN concept END AS told, gold IS NOT DISTINCT FROM CASE WHEN score >= 0.3 THEN concept END AS ok FROM top"
RATES_SQL = """count(*) AS n, count(*) FILTER (gold IS NOT NULL AND ok) AS tp, count(*) FILTER (told IS NOT NULL AND NOT ok) AS fp, count(*) FILTER (gold IS NOT NULL AND NOT ok) AS fn,
  count(*) FILTER (gold IS NULL AND told IS NOT NULL) AS over_assigned, count(*) FILTER (gold IS NOT NULL AND told IS NOT NULL AND NOT ok) AS wrong,
  count(*) FILTER (gold IS NOT NULL AND told IS NULL) AS missed, count(told) AS assigned"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir).withColumn("predicted", F.when(F.col("score") >= 0.3, F.col("concept")))


@query(f"""WITH {SCORES_SQL}, p2 AS ({PRED_SQL}), c AS (SELECT {RATES_SQL} FROM p2) SELECT *, round(100 * tp / nullif(tp + fp, 0), 4) AS precision,
  round(100 * tp / nullif(tp + fn, 0), 4) AS recall, round(200 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1, round(100 * assigned / n, 4) AS coverage FROM c""")
def open_set_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.open_set(predictions(spark, sf_dir))


@query(f"""WITH {SCORES_SQL}, p2 AS ({PRED_SQL}), c AS (SELECT t, {RATES_SQL} FROM p2 GROUP BY t) SELECT t, over_assigned, wrong, missed, n - over_assigned - wrong - missed AS correct,
  round(100 * over_assigned / nullif(over_assigned + wrong + missed, 0), 4) AS over_share FROM c""")
def error_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.col("over_assigned") + F.col("wrong") + F.col("missed")
    rates = K.open_set(predictions(spark, sf_dir), ("t",))
    return rates.select("t", "over_assigned", "wrong", "missed", (F.col("n") - errors).alias("correct"), rounded(100 * F.col("over_assigned") / F.nullif(errors.cast("double"), F.lit(0.0)), 4).alias("over_share"))


AUROC_SQL = """SELECT {keys} sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg,
  round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auroc
FROM (SELECT *, rank() OVER ({part} ORDER BY x) + (count(*) OVER ({part2} x) - 1) / 2 AS r FROM ({rows})) {group}"""
LABELLED_SQL = "SELECT quality, toxic AS y, CAST(n_chars // 200 AS BIGINT) AS x, doc_id FROM documents JOIN labels USING (doc_id)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.floor(F.col("n_chars") / 200)
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", F.col("toxic").cast("long").alias("y"), x.alias("x"))


@query(AUROC_SQL.format(keys="", part="", part2="PARTITION BY", rows=LABELLED_SQL, group=""))
def auroc_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.auroc(labelled(spark, sf_dir), "x", "y")


@query(AUROC_SQL.format(keys="quality,", part="PARTITION BY quality", part2="PARTITION BY quality,", rows=LABELLED_SQL, group="GROUP BY quality"))
def auroc_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.auroc(labelled(spark, sf_dir), "x", "y", ("quality",))


@query(f"""SELECT count(*) AS n_pos, round(avg(tp / r), 6) AS average_precision FROM (SELECT y, sum(y) OVER (ORDER BY x DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp,
  row_number() OVER (ORDER BY x DESC, doc_id) AS r FROM ({LABELLED_SQL})) WHERE y = 1""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.average_precision(labelled(spark, sf_dir), "x", "y", "doc_id")


CALIBRATED_SQL = """SELECT theta, count(*) FILTER (score >= theta AND gold = concept) AS tp, count(*) FILTER (score >= theta AND gold IS DISTINCT FROM concept) AS fp,
  count(gold) - count(*) FILTER (score >= theta AND gold = concept) AS fn FROM top, (SELECT round(i * 0.02, 2) AS theta FROM range(-30, 51) r(i)) GROUP BY theta"""


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(-30, 51).select(rounded(F.col("id") * 0.02, 2).alias("theta"))
    return K.calibrate(top(spark, sf_dir).withColumn("predicted", F.col("concept")), grid)


@query(f"WITH {SCORES_SQL} SELECT *, theta::DOUBLE AS theta, round(200 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM ({CALIBRATED_SQL})".replace("*, theta::DOUBLE AS theta", "theta::DOUBLE AS theta, tp, fp, fn"))
def theta_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrated(spark, sf_dir)


@query(f"WITH {SCORES_SQL}, c AS (SELECT theta::DOUBLE AS theta, round(200 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM ({CALIBRATED_SQL})) SELECT theta, f1 FROM c ORDER BY f1 DESC, theta LIMIT 1")
def best_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.best_threshold(calibrated(spark, sf_dir))


POINTS_SQL = f"""SELECT row_number() OVER w AS rank, round(100 * count(*) OVER w / count(*) OVER (), 6) AS coverage, round(100 * sum(ok) OVER w / count(*) OVER w, 6) AS precision
FROM (SELECT vec_id, score, CAST(gold IS NOT DISTINCT FROM concept AS INT) AS ok FROM top) WINDOW w AS (ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top(spark, sf_dir).withColumn("ok", F.col("gold").eqNullSafe(F.col("concept")).cast("int"))
    return K.curve(rows, "score", "ok", "field_key")


@query(f"WITH {SCORES_SQL} {POINTS_SQL}")
def precision_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir)


@query(f"""WITH {SCORES_SQL}, pts AS ({POINTS_SQL}) SELECT round(sum(a) / nullif(max(coverage) - min(coverage), 0), 4) AS area FROM (SELECT coverage,
  (coverage - lag(coverage) OVER (ORDER BY coverage, rank)) * (precision + lag(precision) OVER (ORDER BY coverage, rank)) / 2 AS a FROM pts)""")
def curve_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.curve_area(points(spark, sf_dir))


@query(f"WITH {SCORES_SQL}, pts AS ({POINTS_SQL}) SELECT coverage, precision FROM pts WHERE coverage >= 50 ORDER BY coverage, rank LIMIT 1")
def precision_at_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.at_coverage(points(spark, sf_dir), 50.0)


REPLICATES, DEPTH = 2000, 10
_LOW = (1 << 32) - 1
#: A replicate is drawn by halving the places of 1,024 cells ten times. The count of a node
#: goes to its left half as far as the binomial law is below the node's hashed number.
UNIFORM_SQL = f"(rep * {0x9E3779B1} + node * {0x42B2AE3D} + {0x27D4EB2F}) & {_LOW}"
for _shift, _factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
    UNIFORM_SQL = f"(SELECT (xor(h, h >> {_shift}) * {_factor}) & {_LOW} FROM (SELECT {UNIFORM_SQL} AS h))"
UNIFORM_SQL = f"(SELECT (xor(h, h >> 15) + 0.5) / 4294967296.0::DOUBLE FROM (SELECT {UNIFORM_SQL} AS h))"


def _halved(k: int) -> str:
    """Counts of the nodes of level k + 1 from those of level k; nodes are numbered as in a heap."""
    law = "exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + j * ln(wl / w) + (m - j) * ln(1 - wl / w))"
    return f"""w{k} AS (SELECT node, sum(n)::DOUBLE AS w, sum(n) FILTER (place < {1 << (DEPTH - k - 1)})::DOUBLE AS wl FROM (
  SELECT {1 << k} + (i >> {DEPTH - k}) AS node, i & {(1 << (DEPTH - k)) - 1} AS place, n FROM cells) GROUP BY node),
d{k} AS (SELECT rep, node, m, w, coalesce(wl, 0) AS wl, CASE WHEN wl < w THEN {UNIFORM_SQL} END AS u FROM l{k} JOIN w{k} USING (node) WHERE m > 0),
b{k} AS (SELECT rep, node, m, CASE WHEN wl = w THEN m WHEN wl = 0 THEN 0 END AS l FROM d{k} WHERE wl = w OR wl = 0
  UNION ALL SELECT rep, node, m, count(*) FILTER (c < u) FROM (SELECT rep, node, m, u, sum({law}) OVER (PARTITION BY rep, node ORDER BY j) AS c
    FROM (SELECT *, unnest(range(0, m + 1)) AS j FROM d{k} WHERE wl > 0 AND wl < w)) GROUP BY rep, node, m),
l{k + 1} AS (SELECT rep, 2 * node AS node, l AS m FROM b{k} UNION ALL SELECT rep, 2 * node + 1, m - l FROM b{k})"""


BOOT_SQL = f"""WITH cells AS (SELECT x, y, count(*) AS n, row_number() OVER (ORDER BY x, y) - 1 AS i FROM ({LABELLED_SQL}) GROUP BY x, y),
l0 AS (SELECT rep, 1::BIGINT AS node, (SELECT sum(n)::BIGINT FROM cells) AS m FROM range({REPLICATES}) r(rep)), """ + ", ".join(map(_halved, range(DEPTH))) + f""",
o AS (SELECT rep, x, y, m FROM l{DEPTH} JOIN cells ON node = {1 << DEPTH} + i WHERE m > 0)"""
WEIGHTED_AUROC_SQL = """SELECT rep, round((sum(p * (below + (t + 1) / 2)) - sum(p) * (sum(p) + 1) / 2) / nullif(sum(p) * (sum(t) - sum(p)), 0), 6) AS auroc
FROM (SELECT *, sum(t) OVER (PARTITION BY rep ORDER BY x) - t AS below FROM (SELECT rep, {x} AS x, sum(m * y)::DOUBLE AS p, sum(m)::DOUBLE AS t FROM o GROUP BY 1, 2)) GROUP BY rep"""


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates of the labelled rows as counts of (x, y)."""
    return S.replicates(labelled(spark, sf_dir).select("x", "y"), ["x", "y"], REPLICATES)


@query(f"""{BOOT_SQL} SELECT count(*) AS n_rep, round(quantile_cont(auroc, 0.025), 5) AS low, round(quantile_cont(auroc, 0.975), 5) AS high FROM ({WEIGHTED_AUROC_SQL.format(x="x")}) WHERE auroc IS NOT NULL""")
def bootstrap_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = K.auroc(resampled(spark, sf_dir), "x", "y", ("rep",), "weight").filter("auroc IS NOT NULL")
    low, high = (rounded(F.percentile("auroc", p), 5) for p in (0.025, 0.975))
    return reps.agg(F.count(F.lit(1)).alias("n_rep"), low.alias("low"), high.alias("high"))


@query(f"""{BOOT_SQL}, a AS ({WEIGHTED_AUROC_SQL.format(x="x")}), z AS ({WEIGHTED_AUROC_SQL.format(x="(x % 7)")}) SELECT round(avg(a.auroc - z.auroc), 5) AS delta, round(quantile_cont(a.auroc - z.auroc, 0.025), 5) AS low,
  round(quantile_cont(a.auroc - z.auroc, 0.975), 5) AS high, round(avg(CAST(a.auroc - z.auroc <= 0 AS INT)), 5) AS p_not_above,
  quantile_cont(a.auroc - z.auroc, 0.025) > -0.2 AND quantile_cont(a.auroc - z.auroc, 0.975) < 0.2 AS equivalent FROM a JOIN z USING (rep)""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms on the same replicates; equivalent if the interval is inside the margin."""
    draws = scratch.stored(resampled(spark, sf_dir), "replicates")
    arm = K.auroc(draws, "x", "y", ("rep",), "weight").select("rep", F.col("auroc").alias("a"))
    other = K.auroc(draws.withColumn("x", F.col("x") % 7), "x", "y", ("rep",), "weight").select("rep", F.col("auroc").alias("b"))
    deltas = arm.join(other, "rep").select((F.col("a") - F.col("b")).alias("d")).filter("d IS NOT NULL")
    low, high = F.percentile("d", 0.025), F.percentile("d", 0.975)
    return deltas.agg(
        rounded(F.avg("d"), 5).alias("delta"),
        rounded(low, 5).alias("low"),
        rounded(high, 5).alias("high"),
        rounded(F.avg((F.col("d") <= 0).cast("int")), 5).alias("p_not_above"),
        ((low > -0.2) & (high < 0.2)).alias("equivalent"),
    )


@query(f"""WITH {SCORES_SQL} SELECT b AS bin, count(*) AS n, round(100 * avg(CAST(gold IS NULL AS INT)), 4) AS unknown_share
FROM (SELECT gold, CASE WHEN score < 0.1 THEN '<.1' WHEN score < 0.3 THEN '.1-.3' WHEN score < 0.5 THEN '.3-.5' ELSE '>=.5' END AS b FROM top) GROUP BY b HAVING count(*) >= 10""")
def coverage_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    bins = F.when(s < 0.1, "<.1").when(s < 0.3, ".1-.3").when(s < 0.5, ".3-.5").otherwise(">=.5")
    counted = top(spark, sf_dir).groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), rounded(100 * F.avg(F.col("gold").isNull().cast("int")), 4).alias("unknown_share"))
    return counted.filter("n >= 10")


@query(f"WITH {SCORES_SQL} SELECT t, count(DISTINCT gold) AS n_concepts, count(*) AS n_fields, count(gold) AS n_gold, count(*) - count(gold) AS n_unknown FROM top GROUP BY t")
def evalset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir).groupBy("t").agg(
        F.countDistinct("gold").alias("n_concepts"), F.count(F.lit(1)).alias("n_fields"), F.count("gold").alias("n_gold"), F.count_if(F.col("gold").isNull()).alias("n_unknown")
    )


@query(f"""WITH {SCORES_SQL} SELECT vec_id AS field_key, v.variant, CASE v.variant WHEN 'oracle' THEN gold WHEN 'embedding' THEN concept ELSE CASE WHEN score >= 0.3 THEN concept END END::BIGINT AS concept
FROM top, (VALUES ('oracle'), ('embedding'), ('abstain')) v(variant)""")
def export_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = {"oracle": F.col("gold"), "embedding": F.col("concept"), "abstain": F.when(F.col("score") >= 0.3, F.col("concept"))}
    variants = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("concept")) for k, v in ways.items()))).alias("v")
    return top(spark, sf_dir).select("field_key", variants).select("field_key", "v.variant", "v.concept")
