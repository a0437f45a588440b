"""Retrieval under the true compatibility rules, completions, experts' errors, unit tables.

A held-out vector is a field whose wording is picked by its number, a concept's
representative one picked by the concept's; concept 7 has no representative.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as G
from ..functions import statements as T
from ..functions import units as U
from ..functions import vocabulary as V
from ..functions.portable import rounded
from ..operators import matching as M
from ..operators import metrics as K
from ..operators import relational as R
from . import rules as P
from .base import Registry, table
from .matching import AUROC_SQL, LABELLED_SQL, SCORES_SQL, labelled, ranking

registry = Registry()
query = registry.query


def _spec(side: str, number: str, shift: int) -> dict[str, Column]:
    def one(values: list[str], step: int) -> Column:
        return F.get(F.array(*map(F.lit, values)), (F.col(number) * step % len(values)).cast("int"))

    picks = {side + k: one(values, step + shift) for k, (values, step) in P.SLOTS.items()}
    return picks | {side + "dtype_declared": (F.col(number) + shift) % 2 == 0}


def _spec_sql(side: str, number: str, shift: int) -> str:
    picks = [f"{P.listed(values)}[({number} * {step + shift}) % {len(values)} + 1] AS {side}{k}" for k, (values, step) in P.SLOTS.items()]
    return ", ".join([*picks, f"({number} + {shift}) % 2 = 0 AS {side}dtype_declared"])


def judged(spark: SparkSession, sf_dir: str, k: int = 5, more: tuple[str, ...] = ()) -> DataFrame:
    """The ranking with the gate of each field and its candidate's representative, and ``more`` of both."""
    ranked = ranking(spark, sf_dir, k).select("field_key", "concept", "score", "rank", "label", "t")
    # What the rules derive is derived once a field and once a concept, not once a pair.
    described = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("field_key"))
    described = G.prepare(described.withColumns(_spec("a_", "field_key", 0)), "a_")
    representatives = G.prepare(spark.range(8).withColumnRenamed("id", "concept").withColumns(_spec("b_", "concept", 3)), "b_")
    known = ranked.join(F.broadcast(representatives), "concept").join(described, "field_key")  # a catalogue
    gate = G.gate(G.Field.at("a_", prepared=True), G.Field.at("b_", prepared=True), concept_mode=True)
    known = known.withColumns({"gate": gate, "has_representative": F.col("concept") < 7})
    violation = M.violations(F.col("gate"), F.col("has_representative"))
    return known.withColumn("violation", violation).select("field_key", "concept", "score", "rank", "label", "t", "gate", "has_representative", "violation", *more)


#: The ranking's pairs in the place of the parts that the rules' SQL reads.
PAIRS = f"SELECT *, {_spec_sql('a_', 'vec_id', 0)}, {_spec_sql('b_', 'concept', 3)} FROM ranked WHERE rank <= 5"
JUDGED = (
    f"WITH {SCORES_SQL}, j AS (SELECT *, v_unit = 1 OR v_type = 1 OR v_specimen = 1 OR v_prov = 1 AS hard, "
    "CASE WHEN concept < 7 THEN v_unit + v_type + v_specimen END AS total, CASE WHEN concept < 7 THEN greatest(v_unit, v_type, v_specimen) END AS most "
    f"FROM ({P.verdicts_sql(True).replace(P.PAIRS_SQL, PAIRS)}))"
)


@query(f"""{JUDGED} SELECT vec_id AS field_key, concept::BIGINT AS concept, s AS score, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, rank, concept) AS rank
FROM (SELECT *, round(score + 0.3 * 0.5 - v_unit - v_type - 0.5 * v_prov, 6) AS s FROM j WHERE NOT hard)""")
def rule_gated_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark, sf_dir)
    return M.rescore(found.select("field_key", "concept", "score", "rank"), found.select("field_key", "concept", "gate", F.lit(0.5).alias("stat")))


@query(f"{JUDGED} SELECT vec_id AS field_key, concept::BIGINT AS concept, total, most FROM j")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("field_key", "concept", "violation.total", "violation.most")


@query(f"""{JUDGED} SELECT vec_id AS field_key, concept::BIGINT AS concept, mode FROM j, (VALUES ('hard'), ('any')) m(mode)
WHERE NOT coalesce(CASE mode WHEN 'hard' THEN most >= 1 ELSE total > 0 END, false)""")
def rule_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark, sf_dir)
    kept = [M.drop_violating(found, "violation", mode).select("field_key", "concept", F.lit(mode).alias("mode")) for mode in ("hard", "any")]
    return kept[0].unionByName(kept[1])


@query(f"""{JUDGED} SELECT vec_id AS field_key, concept::BIGINT AS concept, rank, row_number() OVER (PARTITION BY vec_id ORDER BY coalesce(total, 0), rank, concept) AS new_rank FROM j""")
def rule_graded_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark, sf_dir).withColumn("v", F.coalesce("violation.total", F.lit(0.0)))
    return M.graded_rerank(found, "v").select("field_key", "concept", "rank", "new_rank")


@query(f"""{JUDGED} SELECT vec_id AS field_key, concept::BIGINT AS concept, round(s, 6) AS s, CASE WHEN s >= 0.2 THEN concept::VARCHAR ELSE 'UNKNOWN' END AS decision
FROM (SELECT *, CASE WHEN total IS NULL THEN 0.6 * score ELSE score * (1 - 0.1 * total) END AS s FROM j WHERE rank = 1)""")
def rule_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = judged(spark, sf_dir).filter("rank = 1")
    s = M.abstention_score(F.col("score"), F.col("violation.total"), F.lit(True), F.col("has_representative"), 0.1)
    return first.select("field_key", "concept", rounded(s, 6).alias("s"), M.decide(s, F.col("concept").cast("string"), 0.2).alias("decision"))


DIMS = ("unit", "type", "specimen", "prov")
GRID = [(subset, w) for n in range(1, 5) for subset in itertools.combinations(DIMS, n) for w in (0.1, 0.2, 0.3, 0.5)]


@query(f"{JUDGED}, g AS (" + " UNION ALL ".join(
    f"SELECT '{'+'.join(s)}' AS dims, {w}::DOUBLE AS w, CAST(gold < 8 AS BIGINT) AS y, round(score * (1 - {w} * ({' + '.join('v_' + d for d in s)})), 6) AS x FROM j WHERE rank = 1" for s, w in GRID
) + ") " + AUROC_SQL.format(keys="dims, w,", part="PARTITION BY dims, w", part2="PARTITION BY dims, w,", rows="SELECT * FROM g", group="GROUP BY dims, w"))
def dims_weights_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-set AUROC of all 15 subsets of the dimensions by four weights, in one pass."""
    first = judged(spark, sf_dir).filter("rank = 1")
    ways = [F.struct(F.lit("+".join(s)).alias("dims"), F.lit(w).alias("w"), sum((F.col("gate.v_" + d) for d in s[1:]), F.col("gate.v_" + s[0])).alias("v")) for s, w in GRID]
    rows = first.select("score", "label", F.explode(F.array(*ways)).alias("o"))
    x = rounded(F.col("score") * (1 - F.col("o.w") * F.col("o.v")), 6)
    return K.auroc(rows.select("o.dims", "o.w", (F.col("label") < 8).cast("long").alias("y"), x.alias("x")), "x", "y", ("dims", "w"))


@query(f"""WITH {SCORES_SQL} SELECT vec_id AS field_key, CASE WHEN max(score) >= 0.3 THEN list(concept::BIGINT ORDER BY rank) ELSE [] END AS concepts FROM ranked WHERE rank <= 5 GROUP BY vec_id""")
def thresholded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.above(ranking(spark, sf_dir, 5).select("field_key", "concept", "score", "rank"), 0.3)


@query("""SELECT count(*) AS n, round(100 * avg(CAST(b < 1 AS INT)), 4) AS recall_1, round(100 * avg(CAST(b < 5 AS INT)), 4) AS recall_5, round(100 * avg(CAST(b < 8 AS INT)), 4) AS recall_10
FROM (SELECT e.vec_id, count(*) FILTER (e.embedding[i] > e.embedding[label + 1] OR (e.embedding[i] = e.embedding[label + 1] AND i < label + 1)) AS b
  FROM embeddings e, range(1, 9) r(i) WHERE label < 8 GROUP BY e.vec_id)""")
def recall_of_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight numbers of a vector as scores of eight classes; labels 8 and 9 are ignored."""
    target = F.when(F.col("label") < 8, F.col("label")).otherwise(-1)
    return K.recall_of_scores(table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 8).alias("scores"), target.alias("target")), "scores", "target")


def _completions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fields in chunks of 40, and a completion of each chunk that maps four of five."""
    name = F.concat_ws("#", "p_name", "p_partkey")
    fields = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("field_key"), F.floor(F.col("p_partkey") / 40).alias("chunk"), F.lit("t").alias("src_table"), name.alias("label")
    )
    source = F.when(F.col("field_key") % 2 == 0, F.concat_ws(".", "src_table", "label")).otherwise(F.col("label"))
    one = F.struct(source.alias("source_column"), F.array(F.struct(F.concat(F.lit("grp.concept_"), (F.col("field_key") % 12).cast("string")).alias("mapping"))).alias("target_mappings"))
    listed = fields.filter("field_key % 5 <> 0").groupBy("chunk").agg(F.collect_list(one).alias("mappings"))
    return fields, listed.select("chunk", F.concat(F.lit("Here it is: ```json\n"), F.to_json(F.struct("mappings")), F.lit("\n```")).alias("text"))


@query("""SELECT p_partkey AS field_key, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 12 < 9 THEN ['concept_' || (p_partkey % 12)] ELSE [] END AS predicted FROM part""")
def completion_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, completions = _completions(spark, sf_dir)
    concepts = spark.range(9).select(F.concat(F.lit("concept_"), F.col("id")).alias("concept"))
    return M.completion_predictions(completions, fields, concepts)


LINE = "p_brand || '.' || p_name || ' -- '"
REST = "CASE WHEN p_size % 3 = 0 THEN '' ELSE 'category ' || p_type || '; ' END || 'median ' || p_size"


@query(f"""SELECT p_partkey, 'plain' AS variant, {LINE} || {REST} AS line FROM part UNION ALL SELECT p_partkey, 'with_key', {LINE} || 'itemid ' || p_partkey || '; ' || {REST} FROM part""")
def memory_check_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt lines of the memory check: with and without the raw key."""
    category = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    parts = (F.col("p_brand"), F.col("p_name"), category, F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("p_size"))
    ways = {"plain": N.field_line(*parts), "with_key": N.field_line_with_key(F.col("p_partkey").cast("string"), *parts)}
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("line")) for k, v in ways.items()))).alias("v")
    return table(spark, sf_dir, "part").select("p_partkey", both).select("p_partkey", "v.variant", "v.line")


@query(f"""WITH {SCORES_SQL}, p2 AS (SELECT variant, gold, CASE WHEN variant = 'with_key' AND vec_id % 3 = 0 THEN gold WHEN score >= 0.3 THEN concept END AS told FROM top, (VALUES ('plain'), ('with_key')) v(variant))
SELECT variant, count(*) AS n, count(*) FILTER (gold = told) AS tp, round(100 * count(told) / count(*), 4) AS coverage FROM p2 GROUP BY variant""")
def memory_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same measures of both prompt variants, in one relation."""
    first = ranking(spark, sf_dir, 1).withColumn("gold", F.when(F.col("label") < 8, F.col("label")))
    told = F.when(F.col("score") >= 0.3, F.col("concept"))
    known = F.when(F.col("field_key") % 3 == 0, F.col("gold")).otherwise(told)
    ways = F.explode(F.array(F.struct(F.lit("plain").alias("variant"), told.alias("predicted")), F.struct(F.lit("with_key").alias("variant"), known.alias("predicted")))).alias("v")
    return K.open_set(first.select("gold", ways).select("gold", "v.variant", "v.predicted"), ("variant",)).select("variant", "n", "tp", "coverage")


NOTES = ["POC value", "fingerstick glucose", "vent Set Rate", "设定值", "SaO2 by line", "pulse oximetry", "cannot tell", "没有单位", "name is finer", "", "床旁 and cannot"]


def _has(note: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({note}, {P.text(w)})" for w in words) + ")"


@query("SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {_has('note', w)} THEN {P.text(k)}" for w, k in V.ERROR_WORDS) + f"""
  WHEN p_partkey % 4 = 0 THEN 'model abstained, experts assigned' WHEN {_has('note', V.UNDECIDED_WORDS)} THEN 'insufficient metadata to decide' ELSE 'concept naming granularity' END AS kind
FROM (SELECT p_partkey, lower({P.pick_sql(NOTES, 3)}) AS note FROM part)) GROUP BY kind""")
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("p_partkey") % 4 == 0, "UNKNOWN").otherwise("x")
    rows = table(spark, sf_dir, "part").select(N.error_type(P.pick(NOTES, 3), model).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


ANSWERS = ["heart_rate", "UNKNOWN", "", "UNSURE", "sbp", "dbp", "UNKNOWN"]
_COLLAPSED = "CASE WHEN {x} IN ('', 'UNSURE') THEN NULL WHEN {x} = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'ASSIGNED' END"


@query(f"""WITH r AS (SELECT {_COLLAPSED.format(x=P.pick_sql(ANSWERS, 3))} AS a, {_COLLAPSED.format(x=P.pick_sql(ANSWERS, 5))} AS b FROM part),
k AS (SELECT * FROM r WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agreed FROM k),
e AS (SELECT sum(x.n * y.n) AS e FROM (SELECT a AS c, count(*) AS n FROM k GROUP BY a) x JOIN (SELECT b AS c, count(*) AS n FROM k GROUP BY b) y USING (c))
SELECT n, agreed, round((agreed / n - e / (n * n)) / nullif(1 - e / (n * n), 0), 6) AS kappa FROM n, e""")
def kappa_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "part").select(P.pick(ANSWERS, 3).alias("a"), P.pick(ANSWERS, 5).alias("b"))
    return K.kappa_assigned(answers, "a", "b")


@query(f"""SELECT quality, count(*) FILTER (y = 1) AS n_pos, round(avg(tp / r) FILTER (y = 1), 6) AS average_precision FROM (SELECT quality, y,
  sum(y) OVER (PARTITION BY quality ORDER BY x DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (PARTITION BY quality ORDER BY x DESC, doc_id) AS r FROM ({LABELLED_SQL})) GROUP BY quality""")
def transfer_auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.average_precision(labelled(spark, sf_dir), "x", "y", "doc_id", ("quality",))


CONVERSIONS = [
    ("mg/dL", "mmol/L", "0.0555", "", "concentration", "", "a"), ("degF", "degC", "0.5555555555555556", "-32", "temperature", "", "b"),
    ("foo", "bar", "2", "1", "made", "", "c"), ("foo", "bar", "3", "", "made", "", "d"), ("foo", "mmHg", "", "", "made", "needs a weight", "e"),
]
_NORMAL = P.unit_sql("u")


@query(f"""WITH raw AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(P.text, r)) + ')' for r in CONVERSIONS)}) v(f, t, factor, off, dim, cond, src)),
c AS (SELECT a.x AS f, b.x AS t, factor, off, dim, src FROM raw, LATERAL (SELECT {_NORMAL} AS x FROM (SELECT f AS u)) a, LATERAL (SELECT {_NORMAL} AS x FROM (SELECT t AS u)) b),
one AS (SELECT f, t, arg_max(factor, src) AS factor, arg_max(off, src) AS off FROM c GROUP BY f, t),
d AS (SELECT f, min(dim) AS dim FROM c GROUP BY f),
p AS (SELECT p_partkey, p_retailprice, ua, ub, coalesce({P.lookup_sql('ua', V.UNIT_DIMENSIONS)}, da.dim) AS da, coalesce({P.lookup_sql('ub', V.UNIT_DIMENSIONS)}, db.dim) AS db FROM ({P.UNIT_PAIRS_SQL}) q LEFT JOIN d da ON da.f = ua LEFT JOIN d db ON db.f = ub)
SELECT p_partkey, CASE WHEN ua IS NULL OR ub IS NULL THEN 'unknown' WHEN ua = ub THEN 'same' WHEN coalesce(x.factor, y.factor) = '' THEN 'unknown'
  WHEN coalesce(x.factor, y.factor) IS NOT NULL THEN 'convertible' WHEN da <> db THEN 'conflict' ELSE 'unknown' END AS relation,
  round(CASE WHEN ua = ub THEN p_retailprice ELSE (p_retailprice + coalesce(try_cast(x.off AS DOUBLE), 0)) * try_cast(x.factor AS DOUBLE) END, 4) AS converted
FROM p LEFT JOIN one x ON x.f = ua AND x.t = ub LEFT JOIN one y ON y.f = ub AND y.t = ua""")
def unit_table_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations and conversions by a table that users bring along."""
    conversions = spark.createDataFrame(CONVERSIONS, U.TABLE_SCHEMA)
    out = U.with_table(P.fields(spark, sf_dir).select("p_partkey", "p_retailprice", "a_unit_observed", "b_unit_observed"), conversions, "a_unit_observed", "b_unit_observed", "p_retailprice")
    return out.select("p_partkey", "relation", rounded("converted", 4).alias("converted"))


@query(f"WITH f AS ({P.FILES_SQL}) {P.TWO_LEVELS_SQL}")
def two_level_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.triples(P.source_files(spark, sf_dir), "db", "text", "file").filter("pattern = 'P5'")
    return found.select("src_file", "field_key", "concept_raw", "pattern")


@query("""SELECT src_table, value_uom, count(*) AS n, count(value_num) AS n_values, round(sum(value_num), 2) AS total, min(t_offset) AS first, max(t_offset) AS last FROM (
  SELECT l_extendedprice AS value_num, l_returnflag AS value_uom, 'administration' AS src_table, epoch(l_shipdate)::BIGINT // 60 AS t_offset FROM lineitem
  UNION ALL SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END, NULL, 'prescription', epoch(o_orderdate)::BIGINT // 60 FROM orders) GROUP BY src_table, value_uom""")
def drug_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Administered rates and prescribed doses in one canonical relation."""
    given = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate", F.col("l_extendedprice").cast("string").alias("rate"))
    dose = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string")).otherwise("per need")
    ordered = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", dose.alias("dose"))
    rows = R.canonical_drugs(given, "administration", "l_orderkey", "l_partkey", F.floor(F.unix_timestamp("l_shipdate") / 60), "rate", "l_returnflag").unionByName(
        R.canonical_drugs(ordered, "prescription", "o_custkey", "o_orderpriority", F.floor(F.unix_timestamp("o_orderdate") / 60), "dose", None)
    )
    return rows.groupBy("src_table", "value_uom").agg(
        F.count(F.lit(1)).alias("n"), F.count("value_num").alias("n_values"), rounded(F.sum("value_num"), 2).alias("total"), F.min("t_offset").alias("first"), F.max("t_offset").alias("last")
    )


@query("""SELECT p_partkey, p_brand, p_mfgr FROM (SELECT p_partkey, p_brand, 'c' || (p_size % 6) AS p_mfgr, p_size FROM part)
WHERE (p_mfgr = 'c1' AND lower(p_brand) = 'brand#11') OR p_mfgr IN ('c3', 'c4')""")
def category_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of categories under a source's condition, another for all sources."""
    dictionary = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lit("c"), F.col("p_size") % 6).alias("p_mfgr"))
    return R.category_members(dictionary, "p_mfgr", [(["c1"], F.lower("p_brand") == "brand#11"), (["c3", "c4"], None)])


AGE = "CASE WHEN c_acctbal > 8900 THEN '> 89' WHEN c_acctbal < -900 THEN '' ELSE CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR) END"


@query(f"""SELECT c_custkey, CASE WHEN age = '> 89' THEN 90 ELSE try_cast(age AS DOUBLE) END AS years FROM (SELECT c_custkey, {AGE} AS age, c_custkey % 5 AS visit, c_custkey % 40 / 10 AS days FROM customer)
WHERE visit = 1 AND days >= 1 AND CASE WHEN age = '> 89' THEN 90 ELSE try_cast(age AS DOUBLE) END >= 18""")
def adult_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    age = F.when(balance > 8900, "> 89").when(balance < -900, "").otherwise(F.floor(balance / 100).cast("string"))
    stays = table(spark, sf_dir, "customer").select("c_custkey", R.age_years(age).alias("years"))
    return R.cohort(stays, F.col("c_custkey") % 5 == 1, F.col("c_custkey") % 40 / 10, F.col("years"))


CHANNELS = {"click": "active", "view": "passive", "purchase": "active", "scroll": "passive"}


@query(f"""SELECT user_id, channel, round(avg(m), 6) AS value FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL)
JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in CHANNELS.items())}) c(event_type, channel) USING (event_type) GROUP BY user_id, channel""")
def mapped_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame(list(CHANNELS.items()), "event_type string, channel string")
    out = R.channel_means(table(spark, sf_dir, "events"), F.broadcast(mapping), ["user_id"], "event_type", "value")  # a catalogue
    return out.select("user_id", "channel", rounded("value", 6).alias("value"))

