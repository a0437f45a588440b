"""Mergeable sketches of fields, and whether their estimates keep their bounds.

For fields whose distinct values are too many to count exactly: HyperLogLog for distinct
stays, KLL for quantiles, both Spark's own aggregates. Sketches of parts are stored as
binaries and merged later; no part is read again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import join_same

#: log2 of the registers of a HyperLogLog, and k of a KLL sketch.
REGISTERS, K = 12, 400
#: Bounds of the relative error of a count, and of the error of a rank: four deviations.
COUNT_BOUND, RANK_BOUND = 4 * 1.04 / math.sqrt(1 << REGISTERS), 4 * 1.0 / K


def part_sketches(rows: DataFrame, keys: list[str], entity: str, value: str) -> DataFrame:
    """(keys, n, n_numeric, entities, quantiles): one row for each key; null entities and values do not count."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("n_numeric"),
        F.hll_sketch_agg(F.col(entity), F.lit(REGISTERS)).alias("entities"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("quantiles"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts as those of the whole."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("n_numeric").alias("n_numeric"),
        F.hll_union_agg("entities").alias("entities"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def quantile(p: float) -> Column:
    """An estimated quantile; null where a key has no number."""
    return F.when(F.col("n_numeric") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))


def estimates(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.select(*keys, "n", "n_numeric", F.hll_sketch_estimate("entities").alias("n_entities"), *(quantile(p).alias(f"p{round(100 * p):02d}") for p in (0.01, 0.5, 0.99)))


def kept_bounds(told: DataFrame, rows: DataFrame, keys: list[str], entity: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, n_numeric, n_exact, count_kept, rank_kept) of estimates against all rows.

    A count is kept if it is off by at most the bound's share; a quantile if the values
    below it, and up to it, are shares of all that hold the asked one within the bound.
    """
    exact = rows.groupBy(*keys).agg(F.countDistinct(entity).alias("n_exact"))
    at = told.select(*keys, *(F.col(q).alias(f"_{q}") for q in shares))
    joined = join_same(rows.filter(F.col(value).isNotNull()), at, keys)
    below = {q: (F.avg((F.col(value) < F.col(f"_{q}")).cast("int")) - RANK_BOUND <= p) & (F.avg((F.col(value) <= F.col(f"_{q}")).cast("int")) + RANK_BOUND >= p) for q, p in shares.items()}
    ranks = joined.groupBy(*keys).agg(*(c.alias(f"_{q}") for q, c in below.items()))
    out = join_same(join_same(told, exact, keys), ranks, keys, "left")
    kept = F.coalesce(F.least(*(F.col(f"_{q}") for q in shares)) if len(shares) > 1 else F.col(f"_{next(iter(shares))}"), F.lit(True))
    count = F.abs(F.col("n_entities") - F.col("n_exact")) <= F.greatest(COUNT_BOUND * F.col("n_exact"), F.lit(0.5))
    return out.select(*keys, "n", "n_numeric", "n_exact", count.alias("count_kept"), kept.alias("rank_kept"))
