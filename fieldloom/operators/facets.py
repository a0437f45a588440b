"""Facet retrieval and batch losses: sums over slices, in blocks of whole matrices.

A field and a concept are each an array of slices: the global vector and its facets, all
of one length. Their similarity is the sum of the slices' cosines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .matching import dot, norm
from .relational import top_per_key

#: Components of the concepts that a task holds at once (8 MB), and fields of a batch of scores.
CHUNK, TILE = 1 << 20, 512
#: Fields of a block of a batch's Gram matrix.
ROWS = 256
EPS = 1e-9
SCORED = "field_key long, concept long, score double"


def _cube(column: pa.Array) -> np.ndarray:
    """(rows, slices, components) of equal slices; others are an error."""
    n = len(column)
    flat = column.flatten()
    parts = flat.flatten().to_numpy(zero_copy_only=False)
    return parts.reshape(n, len(flat) // max(n, 1), -1) if n else parts.reshape(0, 0, 0)


def _units(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=-1, keepdims=True)) + EPS)


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six decimals, halves away from zero, as ``portable.rounded``."""
    y = x * 1e6
    whole = np.trunc(y)
    return (whole + np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0.0)) / 1e6


def _best(keys: pa.Array, fields: np.ndarray, names: np.ndarray, concepts: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The first k of a block of concepts, of ascending names, for each field."""
    if len(fields) and fields.shape[1:] != concepts.shape[1:]:
        raise ValueError(f"fields of {fields.shape[1:]} slices meet concepts of {concepts.shape[1:]}")
    slices = concepts.shape[1]
    most = min(k, len(names))
    for at in range(0, len(fields), TILE):
        part = fields[at : at + TILE]
        score = part[:, 0] @ concepts[:, 0].T
        alive = np.arange(len(names))
        for s in range(1, slices):
            # A slice adds at most its cosine of one: a concept that no field's kth
            # sum so far, less the same for those before it, can be reached by is out.
            if len(alive) > most:
                kth = np.partition(score, -most, axis=1)[:, -most] - (slices - s)
                keep = (score + (slices - s) >= kth[:, None] - EPS).any(axis=0)
                if not keep.all():
                    alive, score = alive[keep], score[:, keep]
            score += part[:, s] @ concepts[alive, s].T if len(alive) < len(names) else part[:, s] @ concepts[:, s].T
        score = _rounded(score)
        kth = np.partition(score, -min(most, score.shape[1]), axis=1)[:, -min(most, score.shape[1])]
        found = score >= kth[:, None]
        # Of many concepts that are alike, only the first are sent.
        tied = np.nonzero(found.sum(axis=1) > most)[0]
        if len(tied):
            same = score[tied] == kth[tied, None]
            left = most - (found[tied] & ~same).sum(axis=1, keepdims=True)
            found[tied] &= ~same | (same.cumsum(axis=1) <= left)
        i, j = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([keys.slice(at, TILE).take(pa.array(i)), pa.array(names[alive[j]]), pa.array(score[i, j])], ["field_key", "concept", "score"])


def _block(table: pa.Table, key: str) -> tuple[pa.Array, np.ndarray]:
    """Keys and units of slices of a block, by ascending key."""
    table = table.select([key, "slices"]).sort_by(key).combine_chunks()
    keys, slices = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in table.columns)
    return keys, _units(_cube(slices))


def _searcher(spark: SparkSession, names: pa.Array, concepts: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shared = spark.sparkContext.broadcast((names.to_numpy(), concepts))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _best(batch.column("field_key"), _units(_cube(batch.column("slices"))), *shared.value, k)

    return search


def _meeting(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def meet(fields: pa.Table, concepts: pa.Table) -> pa.Table:
        found = []
        if fields.num_rows and concepts.num_rows:
            names, cube = _block(concepts, "concept")
            found = list(_best(*_block(fields, "field_key"), names.to_numpy(), cube, k))
        return pa.Table.from_batches(found, pa.schema([("field_key", pa.int64()), ("concept", pa.int64()), ("score", pa.float64())]))

    return meet


def facet_topk(fields: DataFrame, concepts: DataFrame, k: int = 10, chunk: int = CHUNK) -> DataFrame:
    """(field_key, concept, score, rank): the k concepts of the largest sums of slice cosines.

    ``fields`` (field_key, slices) and ``concepts`` (concept, slices), keys as long.
    Concepts of at most ``chunk`` components are broadcast. More are dealt in blocks of
    about that size, and fields in blocks of four of them; each two blocks meet in one
    task, and nothing of either passes through the driver. A slice at a time, concepts
    that can enter no field's first k any more are left. Ties by the smaller concept.
    Slices of other numbers or lengths are an error.
    """
    spark = fields.sparkSession
    listed = concepts.select(F.col("concept").cast("long").alias("concept"), F.transform("slices", lambda s: s.cast("array<double>")).alias("slices"))
    listed = scratch.stored(listed, "concepts")
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("slices") * F.size(F.get("slices", F.lit(0)))).alias("width")).first()
    if not size["n"]:
        return spark.createDataFrame([], "field_key long, concept long, score double, rank long")
    asked = fields.select(F.col("field_key").cast("long").alias("field_key"), F.transform("slices", lambda s: s.cast("array<double>")).alias("slices"))
    width = max(1, size["width"] or 1)
    parts = -(-size["n"] * width // chunk)
    if parts == 1:
        found = asked.mapInArrow(_searcher(spark, *_block(listed.toArrow(), "concept"), k), SCORED)  # a bounded chunk
    else:
        asked = scratch.stored(asked, "fields")
        groups = max(1, -(-asked.count() * width // (4 * chunk)))
        asked, listed = (
            df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumns({c: F.col(c).cast("int") for c in ("_group", "_part")})
            for df, key, own, n, other, m in ((asked, "field_key", "_group", groups, "_part", parts), (listed, "concept", "_part", parts, "_group", groups))
        )
        found = asked.groupBy("_group", "_part").cogroup(listed.groupBy("_group", "_part")).applyInArrow(_meeting(k), SCORED)
    return top_per_key(found, ["field_key"], [F.desc("score"), F.col("concept")], k)


# Losses of a batch of pairs. Rows: (batch, id, label, a, b) with two vectors each.

LOSS = "batch long, id long, label long, n long, za double, ta double, pa double, zb double, tb double, pb double, n_same long, pos double, neg double"


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a block of rows against a block of columns, for each row."""
    for batch in batches:
        for r in batch.to_pylist():
            a, b, label = (np.array(r[c], float) for c in ("a", "b", "label"))
            other_a, other_b, other = (np.array(r[c], float) for c in ("other_a", "other_b", "other_label"))
            unit_a, unit_b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
            other_ua, other_ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (other_a, other_b))
            same = label[:, None] == other[None, :]
            sums = []
            for own, units in ((a, other_ub), (b, other_ua)):
                # A projection is at most the vector's norm, by which exponents are moved.
                logit = own @ units.T
                weight = np.exp(logit - np.linalg.norm(own, axis=1, keepdims=True))
                sums += [weight.sum(axis=1), (weight * logit).sum(axis=1), (weight * same).sum(axis=1)]
            cosine = unit_a @ other_ub.T
            n = len(label)
            columns = [np.full(n, r["batch"]), np.array(r["id"]), label.astype(np.int64), np.full(n, len(other)), *sums, same.sum(axis=1), (cosine * same).sum(axis=1), (cosine * ~same).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in LOSS.split(", ")])


def matching_loss(pairs: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """(batch, n, loss, positive, negative): cross-modal projection matching of each batch.

    Each vector is projected on all unit vectors of the other side; the softmax of its
    projections is held, by the divergence, against the pairs of its label, in unit length.
    Gram matrices come in blocks of ROWS rows, whose sums add up: no batch is one matrix.
    The mean cosines of pairs of one label and of others are returned, too.
    """
    block = F.floor((F.row_number().over(Window.partitionBy("batch").orderBy("id")) - 1) / ROWS)
    blocks = pairs.select("batch", "id", "label", "a", "b", block.alias("_block")).groupBy("batch", "_block").agg(
        F.array_sort(F.collect_list(F.struct("id", "label", "a", "b"))).alias("_rows")
    )
    rows = blocks.select("batch", *(F.col(f"_rows.{c}").alias(c) for c in ("id", "label", "a", "b")))
    others = blocks.select("batch", *(F.col(f"_rows.{c}").alias(f"other_{c}") for c in ("label", "a", "b")))
    sums = rows.join(others, "batch").mapInArrow(_gram, LOSS)
    whole = sums.groupBy("batch", "id").agg(F.max("label").alias("label"), *(F.sum(c).alias(c) for c in ("n", "za", "ta", "pa", "zb", "tb", "pb", "n_same", "pos", "neg")))
    shift = pairs.select("batch", "id", *(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)).alias(f"_s{c}") for c in ("a", "b")))
    whole = whole.join(shift, ["batch", "id"])

    def side(x: str) -> Column:
        z, t, p = (F.col(c + x) for c in "ztp")
        inside, outside = F.log(1 / F.sqrt("n_same") + epsilon), F.log(F.lit(epsilon))
        return t / z - (F.log(z) + F.col(f"_s{x}")) - (p * inside + (z - p) * outside) / z

    return whole.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(side("a")) + F.avg(side("b"))).alias("loss"),
        (F.sum("pos") / F.sum("n_same")).alias("positive"),
        (F.sum("neg") / F.nullif(F.sum(F.col("n") - F.col("n_same")), F.lit(0))).alias("negative"),
    )


def classification_loss(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(batch, loss, right_a, right_b): each vector, projected on its partner, told its class.

    ``classes`` (label, vector) are the columns of the weights, a catalogue of one row a
    class. Sums of both sides' mean cross entropies; shares of right classes, ties by the
    smaller label.
    """
    listed = classes.groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "vector"))).alias("_w"))  # one row
    joined = pairs.crossJoin(F.broadcast(listed))

    def side(own: str, other: str) -> Column:
        scale = dot(F.col(own), F.col(other)) / norm(F.col(other)) / norm(F.col(other))
        return F.transform("_w", lambda w: scale * dot(F.col(other), w["vector"]) / norm(w["vector"]))

    told = joined.withColumns({"_la": side("a", "b"), "_lb": side("b", "a"), "_i": F.array_position(F.col("_w.label"), F.col("label")).cast("int")})

    def entropy(c: str) -> Column:
        top = F.array_max(c)
        return top + F.log(F.aggregate(c, F.lit(0.0), lambda s, v: s + F.exp(v - top))) - F.element_at(c, F.col("_i"))

    def right(c: str) -> Column:
        return F.avg((F.array_position(F.col(c), F.array_max(c)) == F.col("_i")).cast("int"))

    return told.groupBy("batch").agg((F.avg(entropy("_la")) + F.avg(entropy("_lb"))).alias("loss"), right("_la").alias("right_a"), right("_lb").alias("right_b"))


def diversity_loss(rows: DataFrame, slices: str = "slices") -> DataFrame:
    """(batch, loss): the mean norm of the cosines between a row's different slices, over their squared number."""
    units = F.transform(slices, lambda s: F.transform(s, lambda v: v / (norm(s) + 1e-12)))
    told = rows.select("batch", units.alias("_u"))
    square = F.aggregate(
        F.flatten(F.transform("_u", lambda x, i: F.transform("_u", lambda y, j: F.when(i == j, 0.0).otherwise(dot(x, y) * dot(x, y))))), F.lit(0.0), lambda s, v: s + v
    )
    return told.groupBy("batch").agg((F.avg(F.sqrt(square)) / F.pow(F.max(F.size("_u")), F.lit(2))).alias("loss"))
