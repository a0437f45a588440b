"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source lie in hash order on a line of words, which is cut into blocks.
An epoch of a source takes whole blocks in the order of a permutation, and the words
of one more to meet its target exactly. The block quotas of all sources are split
among output shards by a tree: at each node the left half's share is drawn from the
node's quotas without replacement, and the rest is the right half's. The tree has two
storeys, as such draws may be nested: quotas of groups of sources are split among all
shards, each shard walking its own path from the root, and then each group's share of
every shard among its sources. No node is held anywhere, and no list of sources. Each
shard takes its ranks of each source's permuted blocks, which no other shard has, and
shuffles them locally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, hot_join, stored, word_count

#: Words of a block.
BLOCK_WORDS = 512
#: Blocks that a shard holds and shuffles, and documents that one task lines up.
SHARD_BLOCKS = 16_384
LINE_DOCS = 2_000
#: Groups of sources, whose quotas the upper tree splits: as many for any corpus.
GROUPS = 4096
#: Tasks that walk the upper tree, each for its shards.
WALKERS = 4096
#: Blocks of a node from which a share is drawn by the normal law, its limit: there the
#: generator has no exact draw, and the law's error is far below a thousandth of a share.
EXACT_BLOCKS = 1_000_000_000


def source_name(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source))


def numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``number``, a source's place in code-point order, null last, from 0.

    Sources are dealt into ranges and numbered in each: no task has all.
    """
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranges = stored(sizes.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    # One number for each range.
    counts = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    before = np.cumsum([0, *(n for _, n in counts)])
    rows = [(k, int(b)) for (k, _), b in zip(counts, before)]
    first = sizes.sparkSession.createDataFrame(rows, "_range int, _first long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_place", place).join(F.broadcast(first), "_range").withColumn(
        "number", F.col("_place") + F.col("_first")
    ).drop("_range", "_place", "_first")


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, limit: float) -> DataFrame:
    """``sizes`` (source, source_size, …) with ``weight`` and ``target``, by water-filling.

    Weights repeat over the sources in code-point order, null last. A source's target
    is its share of ``total_share`` times all sizes, at most ``limit`` times its size;
    what others cannot take is shared again by weight. Each round is one sum over the
    sources: the level rises until no further source is full.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    df = numbered(sizes).withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int"))).drop("number")
    df = stored(df.withColumn("cap", limit * F.col("source_size")), "mix-weights")
    total, open_weight = df.agg(F.sum("source_size"), F.sum("weight")).first()
    total, full, level = total_share * (total or 0), -1, 0.0
    while open_weight:
        # Sums of whole numbers below 2**53: the same in any order.
        is_full = F.col("cap") <= F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        row = df.agg(
            F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))),
            F.sum(is_full.cast("long")),
        ).first()
        if row[2] == full:
            break
        held, open_weight, full = row
        if open_weight:
            level = (total - held) / open_weight
    share = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if open_weight else F.col("cap")
    return df.withColumn("target", share.cast("double")).drop("cap")


def lined_up(docs: DataFrame, counts: DataFrame, total: int, seed: int) -> DataFrame:
    """``docs`` (name, size, …) with ``start``, a document's first word on its source's line.

    Lines are in hash order of id, text and size. A source is dealt into hash ranges of
    about LINE_DOCS documents; ranges' totals give their offsets, so no task holds a
    source. (name, part, place) is a row's own, also among repeated ones.
    """
    h = F.xxhash64(F.lit(seed), "doc_id", "size", "hash")
    # 40 bits of the hash choose the range, in hash order.
    high = F.shiftrightunsigned(h, 24)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / LINE_DOCS))
    dealt = hot_join(docs, counts.select("name", "n"), "name", total)
    dealt = dealt.withColumns({"part": F.shiftright(high * parts, 40), "_high": h}).drop("n")
    offsets = dealt.groupBy("name", "part").agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("n"))
    # One row for each LINE_DOCS documents of a source.
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("name", "part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    place = Window.partitionBy("name", "part").orderBy("_high", "doc_id", "hash", "size")
    placed = dealt.withColumns(
        {
            "place": F.row_number().over(place),
            "_own": F.coalesce(F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    return (
        placed.join(offsets, ["name", "part"], "left")
        .withColumn("start", F.col("_own") + F.col("_offset"))
        .drop("_own", "_offset", "_high")
    )


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(ranks: np.ndarray, n: int, key: str) -> np.ndarray:
    """Where a keyed permutation of the numbers below ``n`` puts some of them.

    A Feistel network over the least square of powers of two that holds them, walked
    on until it comes back below ``n``.
    """
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    digest = hashlib.sha256(key.encode()).digest()
    keys = np.frombuffer(digest, np.uint64)
    x = ranks.astype(np.uint64)
    out = np.ones(len(x), bool)
    while out.any():
        left, right = x[out] >> half, x[out] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        x[out] = (left << half) | right
        out = x >= n
    return x.astype(np.int64)


def quotas(sources: DataFrame, block: int) -> DataFrame:
    """A row for each source and epoch that takes any of its words.

    Full blocks are permuted; the words that end a line are a short block of their
    own, taken last. ``blocks`` is the quota: ``full`` whole blocks by rank, and
    ``rest`` words of the next one.
    """
    words = F.least(F.bround("target").cast("long"), 2 * F.col("source_size"))
    df = sources.withColumns({"_words": words, "epoch": F.explode(F.array(F.lit(0), F.lit(1)))})
    size = F.col("source_size")
    df = df.withColumn("_taken", F.least(F.greatest(F.col("_words") - F.col("epoch") * size, F.lit(0)), size))
    df = df.filter(F.col("_taken") > 0).withColumn("n", F.floor(size / block))
    short = F.col("_taken") < F.col("n") * block
    df = df.withColumns(
        {
            "full": F.when(short, F.floor(F.col("_taken") / block)).otherwise(F.col("n")),
            "rest": F.when(short, F.col("_taken") % block).otherwise(F.col("_taken") - F.col("n") * block),
        }
    )
    return df.select(
        F.pmod(F.xxhash64("name"), F.lit(GROUPS)).cast("int").alias("group"),
        "name",
        "epoch",
        "n",
        "full",
        "rest",
        (F.col("full") + (F.col("rest") > 0).cast("long")).alias("blocks"),
    )


def drawn(random: np.random.Generator, held: np.ndarray, total: int) -> np.ndarray:
    """``total`` blocks drawn without replacement from quotas, how many of each."""
    left = int(held.sum())
    if left < EXACT_BLOCKS:
        return random.multivariate_hypergeometric(held, total, method="marginals")
    out = np.zeros_like(held)
    for i, own in enumerate(map(int, held)):
        others = left - own
        low, high = max(0, total - others), min(own, total)
        if others < EXACT_BLOCKS and own < EXACT_BLOCKS and 0 < total <= left:
            out[i] = random.hypergeometric(own, others, total) if left else 0
        elif low < high:
            share = own / left
            spread = (total * share * (1 - share) * (left - total) / max(left - 1, 1)) ** 0.5
            out[i] = min(max(round(random.normal(total * share, spread)), low), high)
        else:
            out[i] = low
        total -= int(out[i])
        left = others
    return out


def shard_counts(quota: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first rank, blocks) of each quota in one shard: its path through the tree."""
    low, high = 0, shards
    first, held = np.zeros_like(quota), quota.copy()
    while high - low > 1:
        middle = (low + high) // 2
        # The left half gets blocks by its number of shards, exactly.
        left_total = int(held.sum()) * (middle - low) // (high - low)
        left = drawn(np.random.default_rng([seed, low, high]), held, left_total)
        if shard < middle:
            held, high = left, middle
        else:
            first, held, low = first + left, held - left, middle
    return first, held


def cells(quota: np.ndarray, counts: np.ndarray, seed: int, group: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, which quotas, first ranks, blocks): quotas split so that cell k gets ``counts[k]``."""
    index = np.flatnonzero(quota)
    work = [(0, len(counts), index, np.zeros(len(index), np.int64), quota[index])]
    while work:
        low, high, index, first, held = work.pop()
        if high - low == 1:
            yield low, index, first, held
            continue
        middle = (low + high) // 2
        left = drawn(np.random.default_rng([seed, 1 << 29, group, low, high]), held, int(counts[low:middle].sum()))
        for a, b, begun, own in ((middle, high, first + left, held - left), (low, middle, first, left)):
            some = own > 0
            if some.any():
                work.append((a, b, index[some], begun[some], own[some]))


def draws(plan: DataFrame, block: int, seed: int) -> DataFrame:
    """(name, epoch, block, words, shard, slot): the blocks that each shard draws."""
    spark = plan.sparkSession
    # At most GROUPS numbers.
    quota = np.zeros(GROUPS, np.int64)
    for r in plan.groupBy("group").agg(F.sum("blocks").alias("blocks")).collect():
        quota[r["group"]] = r["blocks"]
    shards = max(1, -(-int(quota.sum()) // SHARD_BLOCKS))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                _, held = shard_counts(quota, shards, int(shard), seed)
                some = np.flatnonzero(held)
                yield pd.DataFrame({"group": some.astype(np.int32), "shard": np.int64(shard), "count": held[some]})

    def divide(sources: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values(["name", "epoch"], ignore_index=True)
        shares = shares.sort_values("shard", ignore_index=True)
        at, cell, first, count = [], [], [], []
        if len(sources):
            for k, index, begun, own in cells(sources["blocks"].to_numpy(), shares["count"].to_numpy(), seed, int(sources["group"][0])):
                at.append(index)
                cell.append(np.full(len(index), k))
                first.append(begun)
                count.append(own)
        none = [np.zeros(0, np.int64)]
        out = sources.loc[np.concatenate(at or none), ["name", "epoch", "n", "full", "rest"]].reset_index(drop=True)
        out["first"], out["count"] = np.concatenate(first or none), np.concatenate(count or none)
        out["shard"] = shares["shard"].to_numpy()[np.concatenate(cell or none)]
        return out

    def draw(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(["name", "epoch"], ignore_index=True)
        shard = int(parts["shard"][0])
        slots = np.random.default_rng([seed, 1 << 30, shard]).permutation(int(parts["count"].sum()))
        blocks, words = [], []
        for r in parts.itertuples():
            ranks = np.arange(r.first, r.first + r.count)
            # The short block at the line's end has rank n.
            blocks.append(np.where(ranks < r.n, permuted(np.minimum(ranks, max(r.n - 1, 0)), r.n, f"{seed}:{r.epoch}:{r.name}"), r.n) if r.n else ranks)
            words.append(np.where(ranks < r.full, block, r.rest))
        rows = np.repeat(np.arange(len(parts)), parts["count"])
        return pd.DataFrame(
            {
                "name": parts["name"].to_numpy()[rows],
                "epoch": parts["epoch"].to_numpy()[rows],
                "block": np.concatenate(blocks),
                "words": np.concatenate(words),
                "shard": shard,
                "slot": slots,
            }
        )

    shares = spark.range(shards, numPartitions=min(shards, WALKERS)).mapInPandas(walk, "group int, shard bigint, count bigint")
    divided = plan.groupBy("group").cogroup(shares.groupBy("group")).applyInPandas(
        divide, "name string, epoch int, n bigint, full bigint, rest bigint, first bigint, count bigint, shard bigint"
    )
    return divided.groupBy("shard").applyInPandas(draw, "name string, epoch int, block bigint, words bigint, shard bigint, slot bigint")


def pieces(lined: DataFrame, block: int) -> DataFrame:
    """A row for each document and block of its source's line that it has words in.

    ``first`` and ``end`` are the document's words in the block, ``at`` where in the
    block they begin. The short block at the end of a line counts as the next one.
    """
    end = F.col("start") + F.col("size")
    spans = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    df = lined.filter(F.col("size") > 0).withColumn("block", F.explode(spans))
    base = F.col("block") * block
    return df.withColumns(
        {
            "first": F.greatest(base - F.col("start"), F.lit(0)),
            "end": F.least(base + block - F.col("start"), F.col("size")),
            "at": F.greatest(F.col("start") - base, F.lit(0)),
        }
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    total_share: float = 1.5,
    limit: float = 2.0,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) of the mix.

    Documents: a row for each row of ``docs``: ``doc_id``, ``source`` and its ``name``,
    the text's ``hash``, ``size`` in words, ``source_size``, ``target`` (words, the
    source's) and (``part``, ``place``), which with the name are the row's own.
    Segments: what the mix takes of them: ``shard`` and ``slot`` (the block's place in
    it), ``at`` (within the block), ``epoch``, and the document's words from ``first``
    to ``end``.

    A null text has size 0 and is never taken; a null source is a source, last in
    order; a null key sorts first. Repeated rows are taken each for itself. Without
    any words all targets are 0. Reruns agree: all order and chance come from hashes
    of ``seed``. Takes of a source sum to its target, rounded.
    """
    sized = stored(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            source_name(F.col(source)).alias("name"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
        ),
        "mix-sizes",
    )
    total = sized.count()
    totals = sized.groupBy("source", "name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    wanted = stored(targets(totals, weights, total_share, limit), "mix-targets")
    lined = stored(lined_up(sized, wanted, total, seed), "mix-lines")
    # Its rows are as many as the blocks, which the optimizer cannot know: no broadcast.
    taken_blocks = draws(stored(quotas(wanted, BLOCK_WORDS), "mix-quotas"), BLOCK_WORDS, seed).hint("merge")
    # Blocks spread a hot source over all partitions of the join.
    segments = (
        pieces(lined, BLOCK_WORDS)
        .join(taken_blocks, ["name", "block"])
        .withColumn("end", F.least("end", F.col("first") + F.greatest(F.col("words") - F.col("at"), F.lit(0))))
        .filter(F.col("end") > F.col("first"))
        .select("source", "name", "part", "place", "doc_id", "hash", "shard", "slot", "at", "epoch", "first", "end")
    )
    sums = wanted.select("name", "source_size", "target", "n")
    documents = hot_join(lined, sums, "name", total).select(
        "doc_id", "source", "name", "hash", "part", "place", "size", "source_size", "target"
    )
    return documents, segments


ROW = ["name", "part", "place"]


def taken(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """``documents`` with ``taken``: the words that the segments hold of each."""
    held = segments.groupBy(*ROW).agg(F.sum(F.col("end") - F.col("first")).alias("_taken"))
    return (
        documents.join(held, ROW, "left").withColumn("taken", F.coalesce(F.col("_taken"), F.lit(0)).cast("long")).drop("_taken")
    )


def mixed_texts(docs: DataFrame, documents: DataFrame, segments: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``documents`` with ``taken`` and ``pieces``: (shard, slot, at, epoch, text) that the mix takes.

    A shard's training text is its pieces by slot and place; a piece's words are joined
    by blanks. Texts are shuffled once, to the rows that have them.
    """
    piece = F.struct("shard", "slot", "at", "epoch", "first", "end")
    held = segments.groupBy(*ROW).agg(
        F.sum(F.col("end") - F.col("first")).alias("taken"), F.array_sort(F.collect_list(piece)).alias("_spans")
    )

    def whole(name: Column, doc: Column, hashed: Column) -> Column:
        return F.concat_ws("\x00", hashed.cast("string"), F.coalesce(doc.cast("string"), F.lit("null")), name)

    own = whole(source_name(F.col(source)), F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    texts = docs.select(own.alias("_whole"), F.col(text).alias("_text")).groupBy("_whole").agg(F.first("_text").alias("_text"))
    rows = documents.join(held, ROW, "left").withColumn("_whole", whole(F.col("name"), F.col("doc_id"), F.col("hash")))
    rows = rows.join(texts, "_whole", "left")
    kept = F.btrim(F.coalesce(F.col("_text"), F.lit("")), F.lit(SPACES))
    words = F.split(kept, SPACE_RUN)
    rows = rows.withColumns({"_words": words, "taken": F.coalesce("taken", F.lit(0)).cast("long")})
    out = F.transform(
        F.coalesce("_spans", F.array().cast(rows.schema["_spans"].dataType)),
        lambda s: F.struct(
            s["shard"].alias("shard"),
            s["slot"].alias("slot"),
            s["at"].alias("at"),
            s["epoch"].alias("epoch"),
            F.array_join(F.slice("_words", (s["first"] + 1).cast("int"), (s["end"] - s["first"]).cast("int")), " ").alias("text"),
        ),
    )
    return rows.withColumn("pieces", out).drop("_whole", "_text", "_words", "_spans")
