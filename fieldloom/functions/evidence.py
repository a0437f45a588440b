"""Evidence tokens of a field: unit class, group, quantile buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running
from . import vocabulary as V
from .portable import first_match
from .units import dimension, effective_unit

MISSING_BUCKET = 10


def category_group(category: Column) -> Column:
    return F.coalesce(first_match(F.nullif(F.trim(category), F.lit("")), V.CATEGORY_GROUPS), F.lit("other"))


def unit_class(unit: Column, name: Column) -> Column:
    u = effective_unit(unit, name)["unit"]
    return F.when(u.isNull(), "missing").otherwise(F.coalesce(dimension(u), F.lit("other")))


def stat_similarity(x: Column, y: Column) -> Column:
    """1 for equal magnitudes, e⁻¹ for each decade apart; 0.5 where it cannot tell."""
    far = F.abs(x - y) > F.greatest(F.abs(x), F.abs(y), F.lit(1e-6))
    close = F.exp(-F.abs(F.log10(x) - F.log10(y)))
    return (
        F.when(x.isNull() | y.isNull(), 0.5)
        .when((x <= 0) | (y <= 0), F.when(far, 0.5).otherwise(1.0))
        .otherwise(close)
    )


def log_magnitude(x: Column) -> Column:
    return F.log10(F.abs(x) + 1e-6)


def quantile_edges(df: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """One row ``edges``: the sorted values at n·i/buckets, from 0, for i in 1…buckets-1.

    Values are counted first; a value holds all places up to its running count.
    """
    kept = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    counts = kept.groupBy("v").agg(F.count(F.lit(1)).alias("held"))
    ranked = running(counts, "v", {"end": F.col("held")}).crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("n"))))  # one row
    picks = F.explode(F.sequence(F.lit(1), F.lit(buckets - 1)))
    place = F.floor(F.col("n") * F.col("i") / buckets)
    wanted = ranked.withColumn("i", picks).filter((place < F.col("end")) & (place >= F.col("end") - F.col("held")))
    return wanted.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("edges"))


def bucket(value: Column, edges: Column) -> Column:
    """The number of edges not above the value, at most 9; missing is a bucket."""
    below = F.size(F.filter(edges, lambda e: value >= e))
    return F.when(value.isNull(), MISSING_BUCKET).otherwise(F.least(below, F.lit(MISSING_BUCKET - 1))).cast("long")


def concept_tokens(sources: DataFrame, concepts: DataFrame, tokens: dict[str, Column], missing: dict[str, Column]) -> DataFrame:
    """The tokens of each concept's source field with the most rows (least key of equals).

    ``sources`` has (concept, field_key, n_rows) and what the tokens read; a concept
    without any gets ``missing``.
    """
    order = F.struct((-F.col("n_rows")).alias("n"), "field_key")
    best = sources.groupBy("concept").agg(F.min_by(F.struct(*(v.alias(k) for k, v in tokens.items())), order).alias("_t"))
    out = concepts.select("concept").join(best, "concept", "left")
    return out.select("concept", *(F.when(F.col("_t").isNull(), missing[k]).otherwise(F.col("_t")[k]).alias(k) for k in tokens))


def vocabulary_sizes(vocabularies: DataFrame) -> DataFrame:
    """(name, size): entries of each saved vocabulary, and one more place for the missing."""
    return vocabularies.groupBy("name").agg((F.countDistinct("entry") + 1).alias("size"))
