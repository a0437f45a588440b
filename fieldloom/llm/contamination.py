"""Benchmark decontamination as a prefix-filtered join with exact verification.

An item's windows are its runs of ``window`` words (an item of fewer words is one
window). A window lies in a document only if each of its words does, so one word of
it is a sufficient prefix: the rarest one over all documents. Documents are joined
with these prefix words; an occurrence and the place of the word in its windows fix where
in the document a window may lie, whose length bounds it there. What lies there is looked
up among the windows by its hash and compared with the item, word for word: so the work
goes with the document's length, however often an item or a text repeats itself.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, raw_texts, stored

WINDOW = 13
#: Item words in one block of the benchmark; a block is broadcast, blocks run in turn.
BLOCK_WORDS = 2_000_000
#: A-Z become a-z, other ASCII that is no digit or letter a blank; the rest stays.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def item_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered."""
    return text.translate(FOLD).split()


@dataclass
class Block:
    """Some items, as words, and where their prefix words stand."""

    ids: list[str]
    items: list[list[bytes]]
    #: prefix word → (words of a window, the word's place in it), for all windows that it stands for
    prefix: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    #: Distinct windows of each item, by hash: hashes in order, items, first words.
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def vocabulary(self) -> set[bytes]:
        return {w for item in self.items for w in item}

    def order(self, rarity: dict[bytes, int], window: int) -> None:
        """Takes the rarest word of each window, ties by the word, as its prefix."""
        places: dict[bytes, set[tuple[int, int]]] = {}
        hashes, of, starts = array("Q"), array("i"), array("i")
        for n, item in enumerate(self.items):
            span, seen = min(window, len(item)), set()
            for start in range(len(item) - span + 1):
                hashed = window_hash(item[start : start + span])
                if hashed in seen:
                    continue
                seen.add(hashed)
                at = min(range(start, start + span), key=lambda i: (rarity.get(item[i], 0), item[i], i))
                places.setdefault(item[at], set()).add((span, at - start))
                hashes.append(hashed)
                of.append(n)
                starts.append(start)
        order = np.argsort(np.frombuffer(hashes, np.uint64) if hashes else self.hashes, kind="stable")
        self.prefix = {w: sorted(x) for w, x in places.items()}
        self.hashes, self.of, self.start = (np.array(x, k)[order] for x, k in ((hashes, np.uint64), (of, np.int32), (starts, np.int32)))

    def matches(self, words: list[bytes], window: int) -> list[tuple[int, int, int]]:
        """(item, first, end) of all windows in ``words``."""
        keys = self.prefix.keys() & set(words)
        if not keys:
            return []
        found, n = [], len(words)
        for p, word in enumerate(words):
            if word not in keys:
                continue
            for span, offset in self.prefix[word]:
                first, end = p - offset, p - offset + span
                if first < 0 or end > n:
                    continue
                there = words[first:end]
                hashed = np.uint64(window_hash(there))
                i = int(self.hashes.searchsorted(hashed))
                while i < len(self.hashes) and self.hashes[i] == hashed:
                    k, q = int(self.of[i]), int(self.start[i])
                    if self.items[k][q : q + span] == there:
                        found.append((k, first, end))
                    i += 1
        return found


def window_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def read_blocks(items: DataFrame, key: str, text: str, block_words: int, window: int, unnamed: bool) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, streamed partition by partition.

    A longer item is cut into pieces that share ``window`` - 1 words: no window is lost.
    """
    ids, held, size = [], [], 0
    for row in items.select(F.col(key).cast("string"), F.col(text)).toLocalIterator():
        words = item_words((row[1] or "").encode())
        if not words or (row[0] is None and not unnamed):
            continue
        step = max(block_words - window + 1, 1)
        for start in range(0, max(len(words) - window + 1, 1), step):
            piece = words[start : start + step + window - 1]
            ids.append(row[0])
            held.append(piece)
            size += len(piece)
            if size >= block_words:
                yield Block(ids, held)
                ids, held, size = [], [], 0
    if ids:
        yield Block(ids, held)


def word_frequency(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): documents that hold each word, in one scan; for benchmarks of many blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                total.update(set(item_words(raw)))
            # Words are sent before they fill a worker.
            if len(total) > MOST_WORDS:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    return docs.select(text).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


MOST_WORDS = 1_000_000


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def frequency_of(block: Block, counted: DataFrame) -> dict[bytes, int]:
    """What ``word_frequency`` counted of a block's words, of which there are at most BLOCK_WORDS."""
    spark = counted.sparkSession
    own = spark.createDataFrame(pa.table({"word": pa.array(sorted(block.vocabulary()), pa.binary())}))
    return {bytes(r["word"]): r["n"] for r in counted.join(own, "word").collect()}


def document_frequency(docs: DataFrame, text: str, block: Block) -> dict[bytes, int]:
    """Documents that hold each word of the block, over all of ``docs``."""
    wanted = docs.sparkSession.sparkContext.broadcast(block.vocabulary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, vocabulary = Counter(), wanted.value
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                total.update(vocabulary.intersection(item_words(raw)))
        yield _counted(total)

    rows = docs.select(text).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # At most one row for each word of the block, which is bounded.
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def scan(docs: DataFrame, text: str, block: Block, window: int, keep_text: bool) -> DataFrame:
    """Adds the block's runs and items to ``hits`` and ``items``, and ``n_words``.

    The text is the last column if it is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast((block.ids, block.items, block.prefix, block.hashes, block.of, block.start))
    done = [c for c in ("hits", "items") if c in docs.columns]
    rest = [c for c in docs.columns if c not in (text, "hits", "items", "n_words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*shared.value)
        for batch in batches:
            n_words, hits, items = [], [], []
            before = zip(*(batch.column(c).to_pylist() for c in done)) if done else repeat(([], []))
            for raw, (runs, ids) in zip(raw_texts(batch.column(text)), before, strict=False):
                words = item_words(raw)
                found = block.matches(words, window)
                n_words.append(len(words))
                hits.append(merged([(r["first"], r["end"]) for r in runs] + [(a, b) for _, a, b in found]))
                items.append(sorted({*ids, *(block.ids[k] for k, _, _ in found)}, key=lambda i: (i is None, i)))
            columns = {c: batch.column(c) for c in rest}
            columns["n_words"] = pa.array(n_words, pa.int64())
            columns["hits"] = pa.array([[{"first": a, "end": b} for a, b in h] for h in hits], RUNS)
            columns["items"] = pa.array(items, pa.list_(pa.string()))
            if keep_text:
                columns[text] = batch.column(text)
            yield pa.RecordBatch.from_pydict(columns)

    found = "n_words bigint, hits array<struct<first:int,end:int>>, items array<string>"
    fields = [docs.schema[c] for c in rest] + T._parse_datatype_string(found).fields
    schema = T.StructType(fields + [docs.schema[text]] * keep_text)
    return docs.select(*rest, *done, text).mapInArrow(run, schema)


RUNS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits_of(docs: DataFrame, text: str, block: Block, window: int) -> DataFrame:
    """(_row, hits, items) of the rows of ``docs`` (_row, text) that the block hits."""
    found = scan(docs, text, block, window, keep_text=False)
    return found.filter(F.size("hits") > 0).select("_row", "hits", "items")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    percent: int = 5,
    keep_text: bool = False,
    unnamed: bool = False,
) -> DataFrame:
    """``docs`` with what of the benchmark each document holds; without text if not kept.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items``,
    ``items`` (ids with occurring windows, sorted as strings), ``items_sha256``,
    ``hits`` (runs of hit words) and ``contaminated`` (some word is hit, and at least
    ``percent`` in a hundred). Columns of the same name are replaced. A null text has
    no words and is clean; an item without words is left out, and one without an id
    unless ``unnamed``: then it is hit as others are, and counts as a null, last in
    ``items``. Items that share an id count once. One row for each row of ``docs``.

    The benchmark is read in blocks of ``block_words`` words, each broadcast to one
    scan of ``docs``; the texts are not shuffled. Of several blocks, rarity is counted
    in one scan for all, and each stores only the rows that it hits, by their number.
    """
    added = ["n_words", "hits", "items", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.drop(*(c for c in added if c != text))
    blocks = read_blocks(items, item_key, item_text, block_words, window, unnamed)
    block, later = next(blocks, Block([], [])), next(blocks, None)
    if later is not None:
        docs, block = _over_blocks(docs, chain([block, later], blocks), text, window), Block([], [])
    elif block.ids:
        block.order(document_frequency(docs, text, block), window)
    docs = scan(docs, text, block, window, keep_text=keep_text)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["first"]))
    return docs.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
        }
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def _over_blocks(docs: DataFrame, blocks: Iterable[Block], text: str, window: int) -> DataFrame:
    """``docs`` with the ``hits`` and ``items`` of all blocks, not yet merged."""
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "contamination")
    counted = stored(word_frequency(docs, text), "word-frequency")
    tables = []
    for block in blocks:
        block.order(frequency_of(block, counted), window)
        tables.append(stored(hits_of(docs.select("_row", text), text, block, window), "hits"))
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    every = stored(
        every.groupBy("_row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items")), "hits"
    )
    discard(counted, *tables)
    joined = docs.join(every, "_row", "left").drop("_row")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(every.schema[c].dataType)) for c in ("hits", "items")})
