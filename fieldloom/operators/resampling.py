"""Bootstrap replicates as counts of cells: rows are counted once, and never drawn.

A replicate of n rows drawn with replacement is a multinomial vector over the distinct
cells of the rows. A splitting tree over the cells draws it: the count of a node goes to
its left half by a binomial law, down to the leaves. The top of the tree runs over blocks
of cells, each block has a tree of its own, so that no task holds all cells. All numbers
come from hashes of (replicate, block, node): reruns and other engines agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import ordered as O

#: Leaves of a tree, a power of two: cells of a block.
BLOCK = 1024
#: Deviations from the mean at which a binomial law is cut; its rest is below 1e-20.
DEVIATIONS = 10
_EXACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 257)))])


def uniform(replicate: np.ndarray, block: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) of 32 bits, from a hash of the place."""
    low = (1 << 32) - 1
    h = (replicate * 0x9E3779B1 + block * 0x85EBCA77 + node * 0x42B2AE3D + 0x27D4EB2F) & low
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h = ((h ^ h >> shift) * factor) & low
    return ((h ^ h >> 15) + 0.5) / 2.0**32


def log_factorial(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 256).astype(float) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n <= 256, _EXACT[np.minimum(n, 256)], series)


def binomial(m: np.ndarray, left: np.ndarray, whole: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each place the least k whose probability of at most k, of m at left / whole, reaches u."""
    out = np.where(left == whole, m, 0)
    open_ = np.flatnonzero((m > 0) & (left > 0) & (left < whole))
    p = left / np.maximum(whole, 1)
    spread = DEVIATIONS * np.sqrt(m * p * (1 - p)) + DEVIATIONS
    low = np.maximum(0, np.floor(m * p - spread)).astype(np.int64)
    width = (np.minimum(m, np.ceil(m * p + spread)) - low).astype(np.int64) + 1
    open_ = open_[np.argsort(width[open_], kind="stable")]
    while len(open_):
        # Places of like width, as a matrix of some millions of numbers.
        some = max(1, min(1 << 15, (1 << 21) // int(width[open_[: 1 << 15]].max())))
        at, open_ = open_[:some], open_[some:]
        k = low[at, None] + np.arange(width[at].max())
        n, rest = m[at, None], np.maximum(m[at, None] - k, 0)
        log = log_factorial(n) - log_factorial(np.minimum(k, n)) - log_factorial(rest) + k * np.log(p[at, None]) + rest * np.log1p(-p[at, None])
        reached = np.cumsum(np.where(k <= n, np.exp(log), 0.0), axis=1) < u[at, None]
        out[at] = np.minimum(low[at] + reached.sum(axis=1), m[at])
    return out


def split(replicate: np.ndarray, block: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Counts of the leaves for each row, whose total is its ``m``; ``weights`` are its leaves'."""
    leaves = weights.shape[1]
    levels = [weights]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1].reshape(len(weights), -1, 2).sum(axis=2))
    counts = m[:, None]
    for level in reversed(levels[:-1]):
        nodes = counts.shape[1]
        node = nodes + np.arange(nodes)
        shape = (len(weights), nodes)
        u = uniform(np.broadcast_to(replicate[:, None], shape), np.broadcast_to(block[:, None], shape), np.broadcast_to(node, shape))
        left, whole = level[:, ::2], level.reshape(len(weights), -1, 2).sum(axis=2)
        drawn = binomial(counts.ravel(), left.ravel(), whole.ravel(), u.ravel()).reshape(shape)
        counts = np.stack([drawn, counts - drawn], axis=2).reshape(len(weights), -1)
    return counts[:, :leaves]


@F.pandas_udf(ArrayType(LongType()))
def _drawn(replicate: pd.Series, block: pd.Series, m: pd.Series, weights: pd.Series) -> pd.Series:
    """Counts of the cells of each (replicate, block), whose cells are ``weights``."""
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(m)
    sizes = np.array([len(w) for w in weights])
    padded = np.array([max(BLOCK, 1 << (int(s) - 1).bit_length()) for s in sizes])
    for width in np.unique(padded):
        rows = np.flatnonzero(padded == width)
        for at in (rows[i : i + 64] for i in range(0, len(rows), 64)):
            table = np.zeros((len(at), width), np.int64)
            for i, r in enumerate(at):
                table[i, : sizes[r]] = weights.iloc[r]
            counts = split(replicate.to_numpy(np.int64)[at], block.to_numpy(np.int64)[at], m.to_numpy(np.int64)[at], table)
            for i, r in enumerate(at):
                found[r] = counts[i, : sizes[r]]
    return pd.Series(found, dtype=object)


def replicates(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(rep, columns, weight): for each of ``n`` replicates the cells that it holds, with their counts.

    Cells are the distinct ``columns`` of ``rows``; after they are counted, work and size
    go with n times the cells, not the rows. No rows: no replicate has any.
    """
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.struct(*columns))
    placed = O.running(counted, "_cell", {"_at": F.lit(1)}).withColumn("_block", F.floor((F.col("_at") - 1) / BLOCK))
    listed = F.array_sort(F.collect_list(F.struct("_at", "_n", *columns)))
    blocks = placed.groupBy("_block").agg(listed.alias("_cells"), F.sum("_n").alias("_weight"))
    # The blocks' weights are one row: eight bytes for BLOCK cells.
    top = blocks.agg(F.array_sort(F.collect_list(F.struct("_block", "_weight"))).alias("_top"))
    reps = rows.sparkSession.range(n).withColumnRenamed("id", "rep").crossJoin(F.broadcast(top)).filter(F.size("_top") > 0)
    weights = F.col("_top._weight")
    total = F.aggregate(weights, F.lit(0).cast("long"), lambda s, x: s + x)
    dealt = reps.select("rep", F.col("_top._block").alias("_blocks"), F.when(F.size("_top") == 1, F.array(total)).otherwise(_drawn("rep", F.lit(-1).cast("long"), total, weights)).alias("_m"))
    each = dealt.select("rep", F.explode(F.arrays_zip("_blocks", "_m")).alias("x")).select("rep", F.col("x._blocks").alias("_block"), F.col("x._m").alias("_m")).filter("_m > 0")
    joined = each.join(blocks.select("_block", "_cells"), "_block")
    drawn = joined.select("rep", "_cells", _drawn("rep", F.col("_block"), F.col("_m"), F.col("_cells._n")).alias("_w"))
    cells = drawn.select("rep", F.explode(F.arrays_zip("_cells", "_w")).alias("x")).filter("x._w > 0")
    return cells.select("rep", *(F.col(f"x._cells.{c}").alias(c) for c in columns), F.col("x._w").alias("weight"))
