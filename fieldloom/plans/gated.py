"""Rankings under the compatibility rules: rescoring, rejection, abstention and their calibration.

Fields, candidates and gates are those of ``alignment.judged``: every verdict comes from
the rules over the fields' wording, and concept 7 has no representative to be judged by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import rounded
from ..operators import matching as M
from ..operators import metrics as K
from ..operators import relational as R
from .alignment import JUDGED, judged
from .base import Registry
from .matching import AUROC_SQL

registry = Registry()
query = registry.query

#: All eight candidates of a field instead of five.
ALL = JUDGED.replace("WHERE rank <= 5", "WHERE rank <= 8")
FIRST = f"{JUDGED}, f AS (SELECT *, CASE WHEN gold < 8 THEN gold END AS told FROM j WHERE rank = 1)"


def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each field, with its gate and the gold concept."""
    return judged(spark, sf_dir, 1).withColumn("gold", F.when(F.col("label") < 8, F.col("label")))


def total(coalesced: bool = True) -> Column:
    return F.coalesce("violation.total", F.lit(0.0)) if coalesced else F.col("violation.total")


@query(f"""{ALL} SELECT vec_id AS field_key, CAST(concept AS BIGINT) AS concept, s AS score, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, rank, concept) AS rank
FROM (SELECT *, round(score + 0.3 * 0.5 - v_unit - v_type - 0.5 * v_prov, 6) AS s FROM j WHERE NOT hard)""")
def gated_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark, sf_dir, 8)
    return M.rescore(found.select("field_key", "concept", "score", "rank"), found.select("field_key", "concept", "gate", F.lit(0.5).alias("stat")))


@query(f"""{FIRST} SELECT vec_id AS field_key, CAST(concept AS BIGINT) AS concept, round(s, 6) AS s, CASE WHEN s >= 0.2 THEN CAST(concept AS VARCHAR) ELSE 'UNKNOWN' END AS decision
FROM (SELECT *, CASE WHEN total IS NULL THEN 0.6 * score ELSE score * (1 - 0.3 * total) END AS s FROM f)""")
def abstention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.abstention_score(F.col("score"), total(False), F.lit(True), F.col("has_representative"), 0.3)
    told = first(spark, sf_dir)
    return told.select("field_key", "concept", rounded(s, 6).alias("s"), M.decide(s, F.col("concept").cast("string"), 0.2).alias("decision"))


@query(f"""{ALL} SELECT vec_id AS field_key, CAST(concept AS BIGINT) AS concept, rank, row_number() OVER (PARTITION BY vec_id ORDER BY coalesce(most, 0), rank, concept) AS new_rank FROM j""")
def graded_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates by their worst verdict, then as they stood."""
    found = judged(spark, sf_dir, 8).withColumn("v", F.coalesce("violation.most", F.lit(0.0)))
    return M.graded_rerank(found, "v").select("field_key", "concept", "rank", "new_rank")


@query(f"{JUDGED} SELECT vec_id AS field_key, CAST(concept AS BIGINT) AS concept, rank FROM j WHERE 0.1 * coalesce(total, 0) < 0.12")
def graded_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark, sf_dir).withColumn("v", total())
    return M.graded_reject(found, "v", 0.1, 0.12).select("field_key", "concept", "rank")


@query(f"""{FIRST} SELECT count(*) FILTER (score >= 0.3) AS n_assigned, round(100 * avg(CAST(v_unit = 1 AS INT)) FILTER (score >= 0.3 AND concept < 7), 4) AS unit_violation,
  round(100 * avg(CAST(score >= 0.3 AS INT)), 4) AS coverage FROM f""")
def coverage_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields are assigned, and how many of those break the rule on units."""
    kept = F.col("score") >= 0.3
    broken = F.when(kept & F.col("has_representative"), (F.col("gate.v_unit") == 1).cast("int"))
    return first(spark, sf_dir).agg(
        F.count_if(kept).alias("n_assigned"), rounded(100 * F.avg(broken), 4).alias("unit_violation"), rounded(100 * F.avg(kept.cast("int")), 4).alias("coverage")
    )


DIMS = ["unit", "type", "prov"]
SUBSETS = [[d for i, d in enumerate(DIMS) if m >> i & 1] for m in range(1, 8)]


@query(f"{FIRST}, d AS (" + " UNION ALL ".join(
    f"SELECT '{'+'.join(s)}' AS dims, CAST(told IS NOT NULL AS BIGINT) AS y, round(score * (1 - 0.1 * ({' + '.join('v_' + k for k in s)})), 6) AS x FROM f" for s in SUBSETS
) + ") " + AUROC_SQL.format(keys="dims,", part="PARTITION BY dims", part2="PARTITION BY dims,", rows="SELECT * FROM d", group="GROUP BY dims"))
def dim_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-set AUROC for each subset of three dimensions of the gate, in one pass."""
    sums = [F.struct(F.lit("+".join(s)).alias("dims"), sum((F.col(f"gate.v_{d}") for d in s[1:]), F.col(f"gate.v_{s[0]}")).alias("v")) for s in SUBSETS]
    rows = first(spark, sf_dir).withColumn("o", F.explode(F.array(*sums)))
    return K.auroc(rows.select("o.dims", F.col("gold").isNotNull().cast("long").alias("y"), rounded(F.col("score") * (1 - 0.1 * F.col("o.v")), 6).alias("x")), "x", "y", ("dims",))


@query(f"""{FIRST} SELECT kappa, count(*) FILTER (0.1 * coalesce(total, 0) < kappa AND told = concept) AS kept_right, count(*) FILTER (0.1 * coalesce(total, 0) >= kappa) AS rejected
FROM f, (SELECT round(i / 100, 2)::DOUBLE AS kappa FROM range(1, 35) r(i)) GROUP BY kappa""")
def kappa_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rejection bound keeps and rejects. Sums of verdicts take a few values,
    which are counted first, so that the grid meets those and no rows."""
    counts = first(spark, sf_dir).groupBy(total().alias("x")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("concept")).alias("ok"))
    grid = spark.range(1, 35).select(rounded(F.col("id") / 100, 2).alias("kappa"))
    kept = 0.1 * F.col("x") < F.col("kappa")
    return grid.crossJoin(F.broadcast(counts)).groupBy("kappa").agg(  # at most seven rows
        F.sum(F.when(kept, F.col("ok")).otherwise(0)).alias("kept_right"), F.sum(F.when(~kept, F.col("n")).otherwise(0)).alias("rejected")
    )


LAMBDAS = [0.0, 0.05, 0.1, 0.2, 0.5, 1.0]


@query(f"""{ALL}, l AS (SELECT unnest({LAMBDAS})::DOUBLE AS penalty), g AS (SELECT vec_id, penalty, gold, concept, rank, most, round(score - penalty * coalesce(total, 0), 6) AS s FROM j, l),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, penalty ORDER BY s DESC, rank) AS r FROM g) WHERE r = 1)
SELECT penalty, round(100 * avg(CAST(coalesce(most, 0) = 1 AS INT)), 4) AS violations, round(100 * avg(CAST(gold = concept AS INT)), 4) AS right_percent FROM t GROUP BY penalty""")
def lambda_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 violations and accuracy of each penalty, all penalties in one pass."""
    ranked = judged(spark, sf_dir, 8).withColumns({"x": total(), "penalty": F.explode(F.array(*map(F.lit, LAMBDAS)))})
    scored = ranked.withColumn("s", rounded(F.col("score") - F.col("penalty") * F.col("x"), 6))
    best = R.keep_first(scored, ["field_key", "penalty"], [F.desc("s"), F.col("rank")])
    worst = F.coalesce("violation.most", F.lit(0.0)) == 1
    return best.groupBy("penalty").agg(
        rounded(100 * F.avg(worst.cast("int")), 4).alias("violations"), rounded(100 * F.avg((F.col("label") == F.col("concept")).cast("int")), 4).alias("right_percent")
    )


#: Rankers, and whether each needs a threshold to leave a field unassigned.
RANKERS = {"embedding": True, "checks": True, "votes": False, "names": False}
_RANKED = f"""{JUDGED}, rr AS (
  SELECT vec_id, 'embedding' AS ranker, concept, score AS s, rank FROM j UNION ALL
  SELECT vec_id, 'checks', concept, round(CASE WHEN total IS NULL THEN score ELSE score * (1 - 0.1 * total) END, 6), rank FROM j WHERE NOT hard OR concept = 7 UNION ALL
  SELECT vec_id, 'votes', concept, 1.0, rank FROM j WHERE concept = vec_id % 8 AND coalesce(total, 0) < 1 UNION ALL
  SELECT vec_id, 'names', concept, 1.0, rank FROM j WHERE a_raw_name = b_raw_name AND concept < 7),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, ranker ORDER BY s DESC, rank) AS k FROM rr) WHERE k = 1),
asked AS (SELECT vec_id, t, CASE WHEN gold < 8 THEN gold END AS gold, ranker, needs FROM (SELECT DISTINCT vec_id, t, gold FROM j), (VALUES {', '.join(f"('{k}', {v})" for k, v in RANKERS.items())}) n(ranker, needs)),
pr AS (SELECT a.*, s, CASE WHEN NOT needs OR s >= 0.3 THEN concept END AS told FROM asked a LEFT JOIN best b USING (vec_id, ranker))"""


def rankers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_key, t, gold, ranker, needs_theta, score, predicted) of all rankers, by one registry.

    A ranker that needs a threshold is cut at 0.3; the others leave what they do not list.
    """
    known = judged(spark, sf_dir, 5, ("a_raw_name", "b_raw_name"))
    gated = F.when(F.col("violation.total").isNull(), F.col("score")).otherwise(rounded(F.col("score") * (1 - 0.1 * F.col("violation.total")), 6))
    ways = {
        "embedding": F.col("score"),
        "checks": F.when(~F.col("gate.hard_reject") | ~F.col("has_representative"), gated),
        "votes": F.when((F.col("concept") == F.col("field_key") % 8) & (total() < 1), 1.0),
        "names": F.when((F.col("a_raw_name") == F.col("b_raw_name")) & F.col("has_representative"), 1.0),
    }
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("ranker"), F.lit(RANKERS[k]).alias("needs_theta"), v.alias("s")) for k, v in ways.items()))).alias("w")
    rows = known.select("field_key", "t", "label", "concept", "rank", listed).select("field_key", "t", "label", "concept", "rank", "w.*")
    # The best candidate by one partial aggregation; a ranker that lists none has a null one.
    best = F.max_by(F.when(F.col("s").isNotNull(), F.struct("concept", "s")), F.struct(F.coalesce("s", F.lit(-9.0)), -F.col("rank")))
    found = rows.groupBy("field_key", "t", "label", "ranker", "needs_theta").agg(best.alias("b"))
    told = F.when(~F.col("needs_theta") | (F.col("b.s") >= 0.3), F.col("b.concept"))
    return found.select("field_key", "t", F.when(F.col("label") < 8, F.col("label")).alias("gold"), "ranker", "needs_theta", F.col("b.s").alias("score"), told.alias("predicted"))


@query(f"""{_RANKED} SELECT ranker, needs AS needs_theta, t, count(*) AS n, count(*) FILTER (gold = told) AS tp, round(100 * count(told) / count(*), 4) AS coverage FROM pr GROUP BY ranker, needs, t""")
def ranker_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered ranker by domain, those that need a threshold and those that do not."""
    rates = K.open_set(rankers(spark, sf_dir), ("ranker", "needs_theta", "t"))
    return rates.select("ranker", "needs_theta", "t", "n", "tp", "coverage")


_CONSTANT = "SELECT '{name}' AS name, round({value}, 4)::DOUBLE AS value, '{source}' AS source FROM {source}"
CONSTANTS_SQL = [
    ("n_fields", "count(DISTINCT vec_id)", "pr"), ("n_gold", "count(DISTINCT CASE WHEN gold IS NOT NULL THEN vec_id END)", "pr"),
    ("recall_embedding", "100 * avg(CAST(gold = told AS INT)) FILTER (ranker = 'embedding' AND gold IS NOT NULL)", "pr"), ("assigned_share", "avg(CAST(told IS NOT NULL AS INT))", "pr"),
    ("hard_rejects", "count(*) FILTER (hard)", "j"), ("mean_violation", "avg(total)", "j"), ("rows_events", "count(*)", "events"), ("rows_lineitem", "count(*)", "lineitem"),
    ("fields_lineitem", "count(DISTINCT l_partkey)", "lineitem"), ("stays_lineitem", "count(DISTINCT l_orderkey)", "lineitem"), ("unitless_events", "count(*) FILTER (value IS NULL)", "events"),
]


@query(f"{_RANKED} " + " UNION ALL ".join(_CONSTANT.format(name=n, value=v, source=s) for n, v, s in CONSTANTS_SQL))
def constants_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure that a report cites, by name, with the relation it comes from; each relation is read once."""
    from .base import table

    p, j = rankers(spark, sf_dir), judged(spark, sf_dir)
    right = F.when((F.col("ranker") == "embedding") & F.col("gold").isNotNull(), F.coalesce((F.col("gold") == F.col("predicted")).cast("int"), F.lit(None)))
    relations = {
        "pr": (p, {
            "n_fields": F.countDistinct("field_key"), "n_gold": F.countDistinct(F.when(F.col("gold").isNotNull(), F.col("field_key"))),
            "recall_embedding": 100 * F.avg(right), "assigned_share": F.avg(F.col("predicted").isNotNull().cast("int")),
        }),
        "j": (j, {"hard_rejects": F.count_if("gate.hard_reject"), "mean_violation": F.avg("violation.total")}),
        "events": (table(spark, sf_dir, "events"), {"rows_events": F.count(F.lit(1)), "unitless_events": F.count_if(F.col("value").isNull())}),
        "lineitem": (table(spark, sf_dir, "lineitem"), {
            "rows_lineitem": F.count(F.lit(1)), "fields_lineitem": F.countDistinct("l_partkey"), "stays_lineitem": F.countDistinct("l_orderkey"),
        }),
    }
    out = None
    for source, (df, figures) in relations.items():
        row = df.agg(*(rounded(v, 4).cast("double").alias(k) for k, v in figures.items()))
        long = row.unpivot([], list(figures), "name", "value").withColumn("source", F.lit(source))
        out = long if out is None else out.unionByName(long)
    return out
