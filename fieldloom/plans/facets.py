"""Facet retrieval under the rules, and the losses of batches of pairs, over embeddings.

A vector of 64 numbers is four slices of 16: the global one and three facets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as G
from ..functions.portable import rounded
from ..operators import facets as FA
from ..operators import matching as M
from . import rules as P
from .alignment import PAIRS, _spec
from .base import Registry, table
from .matching import SCORES_SQL, fields, representatives

registry = Registry()
query = registry.query

SLICE = 16


def sliced(df: DataFrame, vector: str = "vector") -> DataFrame:
    starts = F.sequence(F.lit(1), F.lit(64 - SLICE + 1), F.lit(SLICE))
    return df.withColumn("slices", F.transform(starts, lambda i: F.slice(vector, i, SLICE)))


#: The sum of the slices' cosines of two vectors v and w.
S_SEM = "list_sum(list_transform([1, 17, 33, 49], lambda i: list_dot_product(v[i:i + 15], w[i:i + 15]) / (sqrt(list_dot_product(v[i:i + 15], v[i:i + 15])) + 1e-9) / (sqrt(list_dot_product(w[i:i + 15], w[i:i + 15])) + 1e-9)))"
SUMS_SQL = SCORES_SQL.split("s AS (SELECT")[0] + f"""s AS (SELECT vec_id, e.label AS gold, t, p.label AS concept, round({S_SEM.replace('v[', 'e.v[').replace('w[', 'p.v[')}, 6) AS score FROM e, p WHERE t >= 7),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, concept) AS rank FROM s)"""


def facet_ranking(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    held = sliced(fields(spark, sf_dir).filter("t >= 7")).select("field_key", "slices")
    return FA.facet_topk(held, sliced(representatives(spark, sf_dir)).select("concept", "slices"), k)


@query(f"WITH {SUMS_SQL} SELECT vec_id AS field_key, CAST(concept AS BIGINT) AS concept, score, rank FROM ranked WHERE rank <= 5")
def facet_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_ranking(spark, sf_dir)


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS field_key, b.vec_id AS concept, round({S_SEM.replace('v[', 'a.v[').replace('w[', 'b.v[')}, 6) AS score
FROM e a, e b WHERE a.vec_id % 20 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field_key ORDER BY score DESC, concept) AS rank FROM s) WHERE rank <= 5""")
def facet_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a concept: a catalogue that is no broadcast where vectors are many."""
    whole = sliced(fields(spark, sf_dir)).select("field_key", "slices")
    return FA.facet_topk(whole.filter("field_key % 20 = 0"), whole.withColumnRenamed("field_key", "concept"), 5)


FACET_GATED = f"""WITH {SUMS_SQL}, j AS (SELECT *, concept < 7 AND (v_unit = 1 OR v_type = 1 OR v_specimen = 1 OR v_prov = 1) AS hard FROM ({P.verdicts_sql(True).replace(P.PAIRS_SQL, PAIRS)})),
g AS (SELECT vec_id, concept, rank, round(CASE WHEN concept < 7 THEN score - v_unit - v_type - 0.5 * v_prov ELSE score END, 6) AS s FROM j WHERE NOT hard)"""


@query(f"{FACET_GATED} SELECT vec_id AS field_key, concept::BIGINT AS concept, s AS score, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, rank) AS rank FROM g")
def facet_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet candidates after the rules; a concept without a representative keeps its score."""
    ranked = facet_ranking(spark, sf_dir)
    described = G.prepare(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("field_key")).withColumns(_spec("a_", "field_key", 0)), "a_")
    representatives = G.prepare(spark.range(7).withColumnRenamed("id", "concept").withColumns(_spec("b_", "concept", 3)), "b_")
    known = ranked.join(F.broadcast(representatives), "concept", "left").join(described, "field_key")  # a catalogue
    gate = F.when(F.col("b_raw_name").isNotNull(), G.gate(G.Field.at("a_", prepared=True), G.Field.at("b_", prepared=True), concept_mode=True))
    return M.gate_ranking(known.select("field_key", "concept", "score", "rank", gate.alias("gate")), (1.0, 1.0, 0.5))


@query(f"""{FACET_GATED}, first AS (SELECT vec_id, arg_max(concept, (s, -rank)) AS concept, max(s) AS s FROM g GROUP BY vec_id)
SELECT vec_id AS field_key, CASE WHEN s >= 0.5 THEN concept END::BIGINT AS concept FROM (SELECT vec_id FROM e WHERE t >= 7) LEFT JOIN first USING (vec_id)""")
def facet_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of each field where its score reaches the threshold, else none."""
    gated = facet_gated(spark, sf_dir).filter("rank = 1")
    held = fields(spark, sf_dir).filter("t >= 7").select("field_key")
    return held.join(gated, "field_key", "left").select("field_key", F.when(F.col("score") >= 0.5, F.col("concept")).alias("concept"))


# Losses. A vector and the next one are a pair, of the first one's label; 32 pairs are a batch.

PAIRED_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT x.vec_id // 64 AS batch, x.vec_id AS id, x.label, x.v AS a, y.v AS b, sqrt(list_dot_product(x.v, x.v)) AS na, sqrt(list_dot_product(y.v, y.v)) AS nb FROM e x JOIN e y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = fields(spark, sf_dir)
    first = whole.filter("field_key % 2 = 0").select(F.col("field_key").alias("id"), "label", F.col("vector").alias("a"))
    second = whole.select((F.col("field_key") - 1).alias("id"), F.col("vector").alias("b"))
    return first.join(second, "id").withColumn("batch", F.floor(F.col("id") / 64))


@query(f"""WITH {PAIRED_SQL}, g AS (SELECT p.batch, p.id, p.label = q.label AS same, list_dot_product(p.a, q.b) / q.nb AS ab, list_dot_product(p.b, q.a) / q.na AS ba,
  list_dot_product(p.a, q.b) / p.na / q.nb AS c FROM p JOIN p q USING (batch)),
z AS (SELECT batch, id, ln(sum(exp(ab))) AS zab, ln(sum(exp(ba))) AS zba, count(*) FILTER (same) AS s FROM g GROUP BY ALL),
r AS (SELECT batch, id, sum(exp(ab - zab) * (ab - zab - ln(CASE WHEN same THEN 1 / sqrt(s) ELSE 0 END + 1e-8))) AS x, sum(exp(ba - zba) * (ba - zba - ln(CASE WHEN same THEN 1 / sqrt(s) ELSE 0 END + 1e-8))) AS y FROM g JOIN z USING (batch, id) GROUP BY ALL),
m AS (SELECT batch, avg(c) FILTER (same) AS pos, avg(c) FILTER (NOT same) AS neg FROM g GROUP BY batch)
SELECT batch, count(*) AS n, round(avg(x) + avg(y), 5) AS loss, round(any_value(pos), 5) AS positive, round(any_value(neg), 5) AS negative FROM r JOIN m USING (batch) GROUP BY batch""")
def batch_matching_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = FA.matching_loss(pairs(spark, sf_dir))
    return found.select("batch", "n", *(rounded(c, 5).alias(c) for c in ("loss", "positive", "negative")))


CLASSES_SQL = """w AS (SELECT label, list(x ORDER BY i) AS w FROM (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
l AS (SELECT batch, id, p.label = w.label AS own, w.label AS class, list_dot_product(a, b) / nb / nb * list_dot_product(b, w) / sqrt(list_dot_product(w, w)) AS x,
  list_dot_product(a, b) / na / na * list_dot_product(a, w) / sqrt(list_dot_product(w, w)) AS y FROM p, w),
r AS (SELECT batch, id, ln(sum(exp(x))) - sum(x) FILTER (own) AS ex, ln(sum(exp(y))) - sum(y) FILTER (own) AS ey, arg_max(own, (x, -class)) AS ra, arg_max(own, (y, -class)) AS rb FROM l GROUP BY batch, id)"""


@query(f"WITH {PAIRED_SQL}, {CLASSES_SQL} SELECT batch, round(avg(ex) + avg(ey), 5) AS loss, round(avg(CAST(ra AS INT)), 5) AS right_a, round(avg(CAST(rb AS INT)), 5) AS right_b FROM r GROUP BY batch")
def batch_classification_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes' weights are their mean vectors."""
    place = F.posexplode("vector").alias("pos", "v")
    means = fields(spark, sf_dir).select("label", place).groupBy("label", "pos").agg(F.avg("v").alias("m"))
    classes = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))
    found = FA.classification_loss(pairs(spark, sf_dir), classes)
    return found.select("batch", *(rounded(c, 5).alias(c) for c in ("loss", "right_a", "right_b")))


@query("""WITH u AS (SELECT vec_id // 64 AS batch, vec_id, i, list_transform(v[i:i + 15], lambda x: x / (sqrt(list_dot_product(v[i:i + 15], v[i:i + 15])) + 1e-12)) AS s
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), unnest([1, 17, 33, 49]) t(i)),
g AS (SELECT a.batch, a.vec_id, sqrt(sum(CASE WHEN a.i <> b.i THEN list_dot_product(a.s, b.s) ** 2 ELSE 0 END)) AS f FROM u a JOIN u b USING (vec_id) GROUP BY ALL)
SELECT batch, round(avg(f) / 16, 6) AS loss FROM g GROUP BY batch""")
def batch_diversity_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sliced(fields(spark, sf_dir)).withColumn("batch", F.floor(F.col("field_key") / 64))
    return FA.diversity_loss(rows).select("batch", rounded("loss", 6).alias("loss"))
