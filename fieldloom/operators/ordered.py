"""Ranks and running sums in an order, whole or of each key, in pieces of bounded size.

A window sorts all rows of its key in one task. Here the order (keys, score, tie) is cut
into ranges of about PIECE rows, wherever keys begin or end: a key of nine tenths of the
rows is in as many pieces as it needs, and a piece may hold many keys. Each piece is
summed by itself, and what stands before it of its first key is added from the pieces'
totals: only keys that reach over a cut have any, so those are fewer than the pieces.

The input is stored once, so that no branch of the plan computes it again, and its rows
tell the number of pieces. An input of one piece is one window, and takes no other step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: Rows of the order that one task sorts.
PIECE = 1_000_000


def join_same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on equal keys, nulls included; the keys stand once."""
    other = b.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys))
    return a.join(other, on, how).drop(*(f"_same_{k}" for k in keys))


def in_pieces(df: DataFrame, by: list[Column]) -> tuple[DataFrame, int]:
    """``df``, stored, with ``_piece``: rows of a lower piece stand before those of a higher one.

    Also the number of pieces. Rows equal in all of ``by`` are in one piece.
    """
    table = scratch.stored(df, "order")
    pieces = table.count() // PIECE + 1
    if pieces == 1:
        return table.withColumn("_piece", F.lit(0)), 1
    dealt = table.repartitionByRange(pieces, *by)
    return scratch.stored(dealt.withColumn("_piece", F.spark_partition_id()), "pieces"), pieces


def running(
    df: DataFrame, score: str, sums: dict[str, Column], tie: str | None = None, descending: bool = False, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Adds each of ``sums``, summed over all rows of the same keys up to this one by (score, tie).

    ``descending`` turns the score's order, not that of ties; nulls then come last, else
    first. Rows equal in both stand in any order. Null keys are one key. No rows: no rows.
    """
    turned = F.desc if descending else F.asc
    order = [turned(score), *([F.asc(tie)] if tie else [])]
    cut, pieces = in_pieces(df, [*(F.asc(k) for k in keys), *order])
    up_to = Window.partitionBy("_piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumns({k: F.sum(c).over(up_to) for k, c in sums.items()})
    if pieces == 1:
        return within.drop("_piece")
    totals = cut.groupBy("_piece", *keys).agg(*(F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_piece", *keys, F.count(F.lit(1)).over(earlier).alias("_over"), *(F.sum(f"_sum_{k}").over(earlier).alias(f"_before_{k}") for k in sums))
    reach = offsets.filter("_over > 0").drop("_over")  # fewer than the pieces
    joined = join_same(within, F.broadcast(reach), ["_piece", *keys], "left")
    whole = joined.withColumns({k: F.col(k) + F.coalesce(F.col(f"_before_{k}"), F.lit(0)) for k in sums})
    return whole.drop("_piece", *(f"_before_{k}" for k in sums))


def weighted_quantiles(cells: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, a column for each share): discrete quantiles of values that stand ``weight`` times.

    A share (a, b) takes the first value up to which there are a / b of the weight: exact,
    and no key's values are gathered. Null values do not count; a key with no other has no
    row.
    """
    told = cells.filter(F.col(value).isNotNull()).select(*keys, value, weight)
    ranked = running(told, value, {"_up_to": F.col(weight)}, keys=tuple(keys))
    totals = told.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    joined = join_same(ranked, totals, keys)
    reached = {name: F.col("_up_to") * b >= F.col("_total") * a for name, (a, b) in shares.items()}
    return joined.groupBy(*keys).agg(*(F.min(F.when(c, F.col(value))).alias(name) for name, c in reached.items()))


def sum_over_steps(df: DataFrame, score: str, tie: str, x: str, y: str) -> DataFrame:
    """(total): the trapezoids between neighbours in the order, summed."""
    cut, _ = in_pieces(df, [F.asc(score), F.asc(tie)])
    here, order = F.struct(F.col(x).alias("x"), F.col(y).alias("y")), Window.partitionBy("_piece").orderBy(score, tie)

    def area(a: Column, b: Column) -> Column:
        return (b["x"] - a["x"]) * (a["y"] + b["y"]) / 2

    inside = cut.select(area(F.lag(here).over(order), here).alias("a"))
    place = F.struct(score, tie)
    ends = cut.groupBy("_piece").agg(F.min_by(here, place).alias("first"), F.max_by(here, place).alias("last"))
    between = ends.select(area(F.lag("last").over(Window.orderBy("_piece")), F.col("first")).alias("a"))
    return inside.unionByName(between).agg(F.sum("a").alias("total"))
