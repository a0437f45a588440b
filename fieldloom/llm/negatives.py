"""Hard negatives by exact norm-bucketed search.

Candidates are sorted by the norm of their vectors and dealt into buckets of like norm.
An inner product is at most the product of the norms (Cauchy-Schwarz), so a bucket whose
largest norm cannot lift an anchor's score over what it still needs is passed over. What
an anchor needs is the lower limit of its window and its running kth score: buckets come
in rounds, largest norms first, and the kth scores of a round bound the next ones.

Anchors meet the candidates in chunks of a fixed number of components, which are the only
thing that is broadcast. Each task keeps the k best of each window of the chunk and sends
those; Spark merges them by window. Scores are whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Rows of a bucket; components of the anchors that a task holds; scores taken at once.
BUCKET, CHUNK, TILE, BLOCK = 16_384, 1 << 21, 512, 4_096
#: Shares of the buckets at which a round ends.
ROUNDS = (64, 8, 1)
#: From this norm on, a score may not fit a long.
LARGEST = 2.0**31
NONE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "anchor long, place int, score long, vec_id long, uid long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Windows(NamedTuple):
    """What is searched for: of each anchor's scores, those in [low, high] and not below ``kth``."""

    vectors: dict[int, np.ndarray]  # of the anchors, by dimension
    row: np.ndarray  # of the anchor's vector in its matrix
    dimension: np.ndarray
    norm: np.ndarray
    label: np.ndarray
    anchor: np.ndarray  # its uid
    place: np.ndarray  # of the window among those of its anchor
    low: np.ndarray
    high: np.ndarray
    kth: np.ndarray

    def needed(self) -> np.ndarray:
        return np.maximum(self.low, self.kth)


def quantised(x: Column) -> Column:
    """floor(256 x) as a double; beyond 2^53 a double has no fraction."""
    scaled = 256 * x.cast("double")
    return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)


def by_norm(rows: DataFrame, vector: str) -> DataFrame:
    """Rows (vec_id, label, ``vector``) as a stored table in buckets of falling norm.

    Left out are rows with a null label or vector, and vectors with a component that is
    null or not finite, or of a norm of 2^31 or more after scaling (scores no long holds).
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(256 * x.cast("double")) < float("inf")))
    whole = rows.filter(F.col("label").isNotNull() & F.col(vector).isNotNull() & finite)
    scaled = whole.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(vector, quantised).alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    normed = scaled.withColumns({"norm": F.sqrt(square), "spread": F.xxhash64("vec_id", "vector")}).filter(F.col("norm") < LARGEST)
    spark, n = rows.sparkSession, rows.count()
    buckets = max(n // BUCKET + 1, min(n // 1024 + 1, 2 * spark.sparkContext.defaultParallelism))
    # Rows of one norm are told apart by a hash, so that copies of a vector fill no bucket.
    dealt = normed.repartitionByRange(buckets, F.desc("norm"), "spread").sortWithinPartitions(F.desc("norm"), "spread")
    return stored(dealt.drop("spread").withColumns({"bucket": F.spark_partition_id(), "uid": F.monotonically_increasing_id()}), "negatives-rows")


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def _by_dimension(batch: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pa.compute.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        yield int(d), batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))


def _scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products: doubles hold all partial sums below 2^53."""
    if largest < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _first(k: int, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """Places of the first k of each slot: higher scores, then smaller ids."""
    order = np.lexsort((uid, ids, -score, slot))
    s = slot[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    place = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
    return order[place < k]


def searcher(spark: SparkSession, windows: Windows, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the first ``k`` rows of each window among a task's candidates.

    ``same``: rows of the anchor's label, but for the anchor; else rows of other labels.
    """
    shared = spark.sparkContext.broadcast(windows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        needed, kept = w.needed().copy(), [np.zeros(0, np.int64)] * 4
        for batch in batches:
            for d, part in _by_dimension(batch):
                vectors, norms = _matrix(part.column("vector"), d), part.column("norm").to_numpy()
                labels, uids = part.column("label").to_numpy(), part.column("uid").to_numpy()
                ids = part.column("vec_id").fill_null(NO_ID).to_numpy()
                for at in range(0, len(ids), BLOCK):
                    of = slice(at, at + BLOCK)
                    top = norms[of].max() * (1 + 1e-9)
                    # The length bound: the block is passed over by windows that it cannot reach.
                    live = np.flatnonzero((w.dimension == d) & (w.low <= w.high) & (w.norm * top >= needed))
                    found = [kept]
                    for tile in (live[i : i + TILE] for i in range(0, len(live), TILE)):
                        rows, back = np.unique(w.row[tile], return_inverse=True)
                        score = _scores(w.vectors[d][rows], vectors[of], w.norm[tile].max() * top)[back]
                        fits = (score >= needed[tile, None]) & (score <= w.high[tile, None])
                        fits &= (labels[of] == w.label[tile, None]) == same
                        if same:
                            fits &= uids[of] != w.anchor[tile, None]
                        if score.shape[1] > k and fits.sum() > 4 * k * len(tile):
                            kth = np.partition(np.where(fits, score, NONE), -k, axis=1)[:, -k]
                            fits &= score >= kth[:, None]
                        i, j = np.nonzero(fits)
                        found.append([tile[i], score[i, j], ids[of][j], uids[of][j]])
                    if len(found) > 1:
                        together = [np.concatenate(x) for x in zip(*found, strict=True)]
                        first = _first(k, *together)
                        kept = [x[first] for x in together]
                        slots, starts, n = np.unique(kept[0], return_index=True, return_counts=True)
                        full = n == k
                        needed[slots[full]] = np.maximum(needed[slots[full]], kept[1][starts[full] + k - 1])
        slot, score, ids, uid = kept
        columns = [w.anchor[slot], w.place[slot].astype(np.int32), score, pa.array(ids, mask=ids == NO_ID), uid]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "place", "score", "vec_id", "uid"])

    return search


def search(candidates: DataFrame, windows: Windows, k: int, same: bool, buckets: int) -> DataFrame:
    """(anchor, place, score, vec_id, uid, rank): the first ``k`` rows of each window, stored.

    Rounds of buckets, largest norms first; what the windows of a round found is what the
    buckets of later ones must reach, and those that no window needs are not read.
    """
    best, begin = None, 0
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    for end in sorted({-(-buckets // share) for share in ROUNDS}):
        needed = windows.needed()
        open_ = windows.low <= windows.high
        least = (needed[open_] / np.maximum(windows.norm[open_], 1e-9)).min(initial=np.inf)
        part = candidates.filter((F.col("bucket") >= begin) & (F.col("bucket") < end) & (F.col("norm") * (1 + 1e-9) >= float(least)))
        found = part.mapInArrow(searcher(candidates.sparkSession, windows, k, same), FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        before, best = best, stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "negatives-best")
        if before is not None:
            discard(before)
        begin = end
        if end < buckets:
            windows = windows._replace(kth=_kth(best, windows, k))
    return best


def _kth(best: DataFrame, windows: Windows, k: int) -> np.ndarray:
    """The kth score of each window that has as many; the windows are one chunk's."""
    full = best.filter(F.col("rank") == k).select("anchor", "place", "score").toArrow()
    known = {(a, p): s for a, p, s in zip(*(full.column(c).to_pylist() for c in ("anchor", "place", "score")), strict=True)}
    return np.array([known.get((a, p), NONE) for a, p in zip(windows.anchor.tolist(), windows.place.tolist(), strict=True)], np.int64)


def _windows_of(anchors: pa.Table) -> Windows:
    """One open window for each anchor."""
    parts, vectors = list(_by_dimension(anchors.combine_chunks())), {}
    columns: dict[str, list[np.ndarray]] = {x: [] for x in ("row", "dimension", "norm", "label", "anchor")}
    for d, part in parts:
        vectors[d] = _matrix(part.column("vector").combine_chunks(), d)
        n = part.num_rows
        for name, x in (("row", np.arange(n)), ("dimension", np.full(n, d)), *((c, part.column(s).to_numpy()) for c, s in (("norm", "norm"), ("label", "label"), ("anchor", "uid")))):
            columns[name].append(x)
    whole = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in columns.items()}
    n = len(whole["row"])
    low = np.full(n, NONE)
    return Windows(vectors, **whole, place=np.zeros(n, np.int64), low=low, high=np.full(n, NO_ID), kth=low)


def _windows_below(positives: pa.Table, anchors: Windows, low: tuple[int, int], high: tuple[int, int]) -> Windows:
    """A window for each anchor and positive: ``low`` to ``high`` parts of the positive's score."""
    where = {a: i for i, a in enumerate(anchors.anchor.tolist())}
    of = np.array([where[a] for a in positives.column("anchor").to_pylist()], np.int64)
    score = positives.column("score").to_numpy().astype(np.int64)

    def share(of: tuple[int, int], s: np.ndarray) -> np.ndarray:  # floor(s a / b), without the product of s and a
        return s // of[1] * of[0] + s % of[1] * of[0] // of[1]

    picked = {c: getattr(anchors, c)[of] for c in ("row", "dimension", "norm", "label", "anchor")}
    place = positives.column("rank").to_numpy().astype(np.int64)
    return Windows(anchors.vectors, **picked, place=place, low=-share(low, -score), high=share(high, score), kth=np.full(len(of), NONE))


def _chunks(stats: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [begin, end) of buckets that hold at most ``limit`` components of anchors, or are one bucket."""
    begin, held, end = None, 0, 0
    for r in stats:
        if begin is not None and held + r["components"] > limit:
            yield begin, r["bucket"]
            begin, held = None, 0
        if r["components"] or r["anchors"]:
            begin = r["bucket"] if begin is None else begin
            held += r["components"]
        end = r["bucket"] + 1
    if begin is not None:
        yield begin, end


def hard_negatives(
    rows: DataFrame,
    vector: str = "embedding",
    anchors: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: tuple[int, int] = (1, 2),
    high: tuple[int, int] = (19, 20),
    chunk: int = CHUNK,
) -> DataFrame:
    """The hardest negatives of each anchor and positive, by exact scores.

    ``rows`` has vec_id, label and ``vector``. Components become floor(256 x); a score is
    the inner product of two rows. Anchors are the rows for which ``anchors`` holds (all,
    if it is not given); positives their first ``n_positives`` other rows of the label;
    negatives the first ``n_negatives`` rows of other labels whose score is from ``low`` to
    ``high`` parts of the positive's. Higher scores stand first, then smaller ids.

    Rows with a null label or vector, or a component that is null or not finite, take no
    part. Each row stands for itself: a repeated row is another row, and a repeated anchor
    is mined again. A null id is the last of its ties. Vectors of other lengths than the
    anchor's are no partners. Extra columns are left out. No rows: no rows. A window below
    a negative positive score holds nothing.
    """
    table = by_norm(rows.select("vec_id", "label", vector), vector)
    wanted = F.lit(True) if anchors is None else F.coalesce(anchors, F.lit(False))
    marked = table.withColumn("_wanted", wanted)
    size = F.when(F.col("_wanted"), F.size("vector")).otherwise(0)
    stats = marked.groupBy("bucket").agg(F.sum(size).alias("components"), F.count_if("_wanted").alias("anchors")).orderBy("bucket").collect()
    buckets = max((r["bucket"] for r in stats), default=-1) + 1
    spark, pieces = rows.sparkSession, []
    for begin, end in _chunks(stats, chunk):
        chosen = marked.filter((F.col("bucket") >= begin) & (F.col("bucket") < end) & F.col("_wanted"))
        mine = _windows_of(chosen.select("uid", "label", "vector", "norm").toArrow())
        positives = search(table, mine, n_positives, True, buckets)
        below = _windows_below(positives.select("anchor", "score", "rank").toArrow(), mine, low, high)
        negatives = search(table, below, n_negatives, False, buckets)
        named = positives.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        told = negatives.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        ids = chosen.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        mined = told.join(named, ["anchor", "place"]).join(ids, "anchor")
        pieces.append(stored(mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-mined"))
        discard(positives, negatives)
    discard(table)
    if not pieces:
        return spark.createDataFrame([], RESULT)
    found = spark.read.schema(RESULT).parquet(*(p._stored_path for p in pieces))
    found._stored_path = pieces[0]._stored_path
    return found
