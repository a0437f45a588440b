"""Rankers, gating, abstention and prototypes. A ranking is (field_key, concept, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..functions.portable import rounded

#: What norms are raised by, so that none is zero.
EPS = 1e-9


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def normalized(x: Column, eps: float = EPS) -> Column:
    return F.transform(x, lambda v: v / (norm(x) + eps))


def cosine_topk(fields: DataFrame, concepts: DataFrame, k: int = 10, most_concepts: int = 20_000) -> DataFrame:
    """(field_key, concept, score, rank): the k nearest concepts of each field.

    ``fields`` (field_key, vector) meet every one of ``concepts`` (concept, vector), a
    catalogue: it is broadcast if it has at most ``most_concepts`` rows, else both
    sides are dealt into blocks and partial top lists are merged.
    """
    # Vectors are divided by their own norms, once: of a unit vector EPS is another part.
    unit_f = fields.select("field_key", F.col("vector").alias("_f"), (norm(F.col("vector")) + EPS).alias("_nf"))
    unit_c = concepts.select("concept", F.col("vector").alias("_c"), (norm(F.col("vector")) + EPS).alias("_nc"))
    score = rounded(dot(F.col("_f"), F.col("_c")) / F.col("_nf") / F.col("_nc"), 6).alias("score")
    if concepts.limit(most_concepts + 1).count() <= most_concepts:
        pairs = unit_f.crossJoin(F.broadcast(unit_c))
    else:
        deal = 64
        spread = unit_f.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
        pairs = spread.join(unit_c.withColumn("_b", F.pmod(F.xxhash64("concept"), F.lit(deal)).cast("int")), "_b")
        pairs = _top(pairs.select("field_key", "_b", "concept", score), ["field_key", "_b"], k)
        return _top(pairs.drop("rank", "_b"), ["field_key"], k)
    return _top(pairs.select("field_key", "concept", score), ["field_key"], k)


def _top(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "concept")).cast("long")
    return scores.withColumn("rank", place).filter(F.col("rank") <= k)


def exact_names(fields: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts whose normalised name is the field's, with score 1."""
    f = fields.select("field_key", normalize_name(F.col("raw_name")).alias("_n")).filter("_n <> ''")
    c = concepts.select("concept", normalize_name(F.col("concept")).alias("_n"))
    return f.join(c, "_n").select("field_key", "concept", F.lit(1.0).alias("score"))


def by_codes(fields: DataFrame, codes: DataFrame, votes: DataFrame) -> DataFrame:
    """Two hops: field → code → the concept that most labelled fields of the code have."""
    counted = votes.groupBy("code", "concept").agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy("code").agg(F.min(F.struct((-F.col("_n")).alias("n"), "concept"))["concept"].alias("concept"))
    return fields.join(codes, "field_key").join(best, "code").select("field_key", "concept", F.lit(1.0).alias("score"))


def prototypes(vectors: DataFrame, cards: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(concept, vector, mean, n_fields, source): class means, in unit length and as they are.

    Of fewer than ``least`` fields the concept's card vector is taken (source 1), or,
    where there is none, the mean all the same (source 2).
    """
    place = F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "v")
    means = vectors.select("concept", place).groupBy("concept", "pos").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    out = means.groupBy("concept").agg(mean.alias("_mean"), F.max("n").alias("n_fields"))
    few = F.col("n_fields") < least
    if cards is None:
        out = out.withColumns({"_v": F.col("_mean"), "source": F.when(few, 2).otherwise(0).cast("long")})
    else:
        out = out.join(cards.select("concept", F.col("vector").cast("array<double>").alias("_card")), "concept", "full_outer")
        few = F.coalesce(few, F.lit(True))
        out = out.withColumns(
            {
                "_v": F.when(few, F.coalesce("_card", "_mean")).otherwise(F.col("_mean")),
                "source": F.when(few, F.when(F.col("_card").isNotNull(), 1).otherwise(2)).otherwise(0).cast("long"),
            }
        )
    return out.select("concept", normalized(F.col("_v")).alias("vector"), F.col("_v").alias("mean"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"), "source")


def slice_cosine(x: Column, y: Column) -> Column:
    """Sum over slices of cosine: arrays of vectors, global slice first."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: dot(a, b) / (norm(a) * norm(b) + 1e-9)), F.lit(0.0), lambda s, v: s + v)


def rescore(ranking: DataFrame, gates: DataFrame, gamma: float = 0.3, weights: tuple = (1.0, 1.0, 0.5)) -> DataFrame:
    """A ranking after its gates (field_key, concept, gate, stat): rejects go, order anew."""
    g = F.col("gate")
    soft = F.col("score") + gamma * F.coalesce("stat", F.lit(0.5)) - weights[0] * g["v_unit"] - weights[1] * g["v_type"] - weights[2] * g["v_prov"]
    kept = ranking.join(gates, ["field_key", "concept"]).filter(~g["hard_reject"])
    place = F.row_number().over(Window.partitionBy("field_key").orderBy(F.desc("score"), F.asc("_before"), "concept")).cast("long")
    return kept.select("field_key", "concept", rounded(soft, 6).alias("score"), F.col("rank").alias("_before")).withColumn("rank", place).drop("_before")


def gate_ranking(ranking: DataFrame, weights: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """A ranking after the gate of each candidate: rejects go, the rest stand by their soft scores.

    A candidate without a gate (null) keeps its score; equal scores stand as they stood.
    """
    g = F.col("gate")
    soft = F.col("score") - weights[0] * g["v_unit"] - weights[1] * g["v_type"] - weights[2] * g["v_prov"]
    kept = ranking.filter(g.isNull() | ~g["hard_reject"]).withColumn("_soft", rounded(F.coalesce(soft, F.col("score")), 6))
    place = F.row_number().over(Window.partitionBy("field_key").orderBy(F.desc("_soft"), "rank")).cast("long")
    return kept.select("field_key", "concept", F.col("_soft").alias("score"), place.alias("rank"))


def abstention_score(base: Column, violation: Column, has_candidate: Column, has_representative: Column, w: float) -> Column:
    return (
        F.when(~has_candidate, 0.0).when(~has_representative, 0.6 * base).otherwise(base * (1 - w * violation))
    )


def decide(score: Column, concept: Column, theta: float) -> Column:
    return F.when(score >= theta, concept).otherwise("UNKNOWN")


def graded_rerank(ranking: DataFrame, violation: str) -> DataFrame:
    """Candidates by their sum of violations, then as they stood."""
    place = F.row_number().over(Window.partitionBy("field_key").orderBy(violation, "rank", "concept")).cast("long")
    return ranking.withColumn("new_rank", place)


def graded_reject(ranking: DataFrame, violation: str, w: float, kappa: float) -> DataFrame:
    return ranking.filter(F.coalesce(w * F.col(violation), F.lit(0.0)) < kappa)


def violations(g: Column, has_representative: Column, dims: tuple[str, ...] = ("unit", "type", "specimen")) -> Column:
    """struct(total, most) of a gate's verdicts over some dimensions; null without a representative."""
    vs = [g["v_" + d] for d in dims]
    most = F.greatest(*vs) if len(vs) > 1 else vs[0]
    return F.when(has_representative, F.struct(sum(vs[1:], vs[0]).alias("total"), most.alias("most")))


def drop_violating(ranking: DataFrame, violation: str, mode: str = "hard") -> DataFrame:
    """A ranking without candidates that conflict (hard), or that may (any); none are added."""
    v = F.col(violation)
    bad = v["most"] >= 1 if mode == "hard" else v["total"] > 0
    return ranking.filter(~F.coalesce(bad, F.lit(False)))


def above(ranking: DataFrame, theta: float) -> DataFrame:
    """(field_key, concepts): a field's whole list if its best score reaches ``theta``, else empty."""
    lists = ranking.groupBy("field_key").agg(F.array_sort(F.collect_list(F.struct("rank", "concept"))).alias("_l"), F.max("score").alias("_top"))
    kept = F.when(F.col("_top") >= theta, F.transform("_l", lambda x: x["concept"]))
    return lists.select("field_key", F.coalesce(kept, F.filter(F.transform("_l", lambda x: x["concept"]), lambda _: F.lit(False))).alias("concepts"))


def completion_predictions(completions: DataFrame, fields: DataFrame, concepts: DataFrame) -> DataFrame:
    """(field_key, predicted) of all ``fields`` (field_key, chunk, src_table, label).

    ``completions`` (chunk, text) are parsed; a field's targets are those of its
    ``table.label``, else of its label, without prefixes and without what is no concept;
    a field that is told nothing gets an empty list.
    """
    from ..functions.names import parse_mappings

    told = completions.select("chunk", F.posexplode(parse_mappings(F.col("text"))).alias("_at", "m")).select(
        "chunk", "_at", F.col("m.source_column").alias("_name"), F.col("m.targets").alias("_targets")
    )
    # Of a name that is told twice the last counts.
    told = told.groupBy("chunk", "_name").agg(F.max_by("_targets", "_at").alias("_targets")).filter(F.size("_targets") > 0)
    names = fields.withColumn("_names", F.array(F.concat_ws(".", "src_table", "label"), F.col("label")))
    asked = names.select("field_key", "chunk", F.posexplode("_names").alias("_way", "_name"))
    best = asked.join(told, ["chunk", "_name"]).groupBy("field_key").agg(F.min_by("_targets", "_way").alias("_targets"))
    plain = best.select("field_key", F.posexplode("_targets").alias("_at", "_t")).select("field_key", "_at", F.substring_index("_t", ".", -1).alias("concept"))
    kept = plain.join(concepts.select("concept").distinct(), "concept").groupBy("field_key").agg(F.array_sort(F.collect_list(F.struct("_at", "concept"))).alias("_l"))
    kept = kept.select("field_key", F.transform("_l", lambda x: x["concept"]).alias("_p"))
    return fields.select("field_key").join(kept, "field_key", "left").select("field_key", F.coalesce("_p", F.array().cast("array<string>")).alias("predicted"))
