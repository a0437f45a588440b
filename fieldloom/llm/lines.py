"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

An index holds, of all documents inserted so far,

* ``refs``: the exact references, a row for each key and document (doc, and alt where it
  has no id), as signed entries
  (+1 inserted, -1 deleted), a table for each change;
* ``counts``: the exact number of documents of a key and the largest of them, a table for
  each change with the new values of the keys that it touched;
* ``filters``: a cuckoo filter for each shard of the keys, which holds one fingerprint for
  each key that has a document.

A key that the filter of its shard does not know is new: it meets none of the older
tables. Only keys that may be known are joined with them, which tells false alarms from
known keys. A document is deleted by its references; a key whose last document goes loses
its fingerprint. What is dropped of a text depends on the tables alone, so that inserting
and deleting documents leaves the answers of an index that never saw them.

Keys are told apart by 128 bits of hash. A key is one row, with its count, before it is
dealt to a shard: a line in a third of all documents is no larger than any other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import SPACES, discard, hot_join, stored

#: Keys that a shard is made for; slots of a bucket; share of the slots in use.
SHARD_KEYS, SLOTS, LOAD = 131_072, 4, 0.85
#: Rounds of evictions after which a filter is full and gets a further table.
EVICTIONS = 200
KEY, DOC = ["h1", "h2"], ["doc", "alt"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints over pairs of 64-bit hashes, in whole arrays.

    Equal fingerprints are held as often as they are inserted, so that deleting a key
    leaves others of its fingerprint in place. What finds no seat in a table waits in its
    stash; a table that is full, or has a stash, is followed by a larger one.
    """

    def __init__(self, tables: list[np.ndarray] | None = None, stashes: list[np.ndarray] | None = None) -> None:
        self.tables, self.stashes = tables or [], stashes or []

    @classmethod
    def read(cls, states: list[dict]) -> Cuckoo:
        return cls(
            [np.frombuffer(s["seats"], np.uint16).reshape(-1, SLOTS).copy() for s in states],
            [np.frombuffer(s["stash"], np.int64).copy() for s in states],
        )

    def written(self) -> list[dict]:
        return [{"seats": t.tobytes(), "stash": s.tobytes()} for t, s in zip(self.tables, self.stashes, strict=True)]

    def __len__(self) -> int:
        return sum(np.count_nonzero(t) for t in self.tables) + sum(map(len, self.stashes))

    @staticmethod
    def _other(bucket: np.ndarray, finger: np.ndarray, n: int) -> np.ndarray:
        """The other bucket of a fingerprint; the same step leads there and back."""
        return bucket ^ ((finger.astype(np.int64) * 0x5BD1E995 >> 5) & (n - 1))

    def _places(self, h1: np.ndarray, h2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        finger = ((h2.view(np.uint64) >> np.uint64(48)) % np.uint64(65_535) + np.uint64(1)).astype(np.uint16)
        # The low bits of h1 tell the shard.
        bucket = (h1 >> 20) & (n - 1)
        return finger, bucket, self._other(bucket, finger, n)

    @staticmethod
    def _code(finger: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) << 16 | finger

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        known = np.zeros(len(h1), bool)
        for table, stash in zip(self.tables, self.stashes, strict=True):
            finger, a, b = self._places(h1, h2, len(table))
            known |= (table[a] == finger[:, None]).any(axis=1) | (table[b] == finger[:, None]).any(axis=1)
            known |= np.isin(self._code(finger, a, b), stash)
        return known

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Holds each pair once more."""
        while len(h1):
            room = 0
            if self.tables and not len(self.stashes[-1]):
                room = int(self.tables[-1].size * LOAD) - np.count_nonzero(self.tables[-1])
            if room <= 0:
                least = max(64, int(len(h1) / (SLOTS * LOAD)) + 1, 2 * len(self.tables[-1]) if self.tables else 0)
                self.tables.append(np.zeros((1 << (least - 1).bit_length(), SLOTS), np.uint16))
                self.stashes.append(np.zeros(0, np.int64))
                continue
            self.stashes[-1] = self._fill(self.tables[-1], h1[:room], h2[:room])
            h1, h2 = h1[room:], h2[room:]

    def _fill(self, table: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Seats all pairs; codes of the fingerprints that are left without a seat."""
        finger, bucket, other = self._places(h1, h2, len(table))
        rest = self._seat(table, finger, bucket)
        finger, bucket = finger[rest], other[rest]
        rng = np.random.default_rng(len(h1))
        for _ in range(EVICTIONS):
            rest = self._seat(table, finger, bucket)
            finger, bucket = finger[rest], bucket[rest]
            if not len(finger):
                break
            # In each full bucket one that waits takes the seat of another, which goes to its other bucket.
            at, first = np.unique(bucket, return_index=True)
            slot = rng.integers(0, SLOTS, len(at))
            out = table[at, slot]
            table[at, slot] = finger[first]
            finger[first] = out
            bucket[first] = self._other(at, out, len(table))
        return self._code(finger, bucket, self._other(bucket, finger, len(table)))

    @staticmethod
    def _seat(table: np.ndarray, finger: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; places of those that found none."""
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, int)
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        free = table[sorted_] == 0
        seated = rank < free.sum(axis=1)
        slot = np.argsort(~free[seated], axis=1, kind="stable")[np.arange(seated.sum()), rank[seated]]
        table[sorted_[seated], slot] = finger[order[seated]]
        return np.sort(order[~seated])

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Takes one fingerprint of each pair out; the pairs have been inserted before."""
        for k in range(len(self.tables) - 1, -1, -1):
            table = self.tables[k]
            while len(h1):
                finger, a, b = self._places(h1, h2, len(table))
                code = self._code(finger, a, b)
                stashed = np.isin(code, self.stashes[k])
                near, far = table[a] == finger[:, None], table[b] == finger[:, None]
                held = near.any(axis=1) | far.any(axis=1)
                bucket = np.where(near.any(axis=1), a, b)
                seat = bucket * SLOTS + np.where(near.any(axis=1), near.argmax(axis=1), far.argmax(axis=1))
                # Equal fingerprints meet at one seat: one of them takes it, the others look again.
                seat = np.where(held, seat, -1 - code)
                _, first = np.unique(seat, return_index=True)
                done = first[(held | stashed)[first]]
                if not len(done):
                    break
                table.reshape(-1)[seat[done[held[done]]]] = 0
                for c in code[done[~held[done]]]:
                    self.stashes[k] = np.delete(self.stashes[k], np.flatnonzero(self.stashes[k] == c)[0])
                h1, h2 = np.delete(h1, done), np.delete(h2, done)


def key_of(line: Column) -> Column:
    """A line as lines are compared: ASCII blanks off both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _pair(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("h1").to_numpy().astype(np.int64), table.column("h2").to_numpy().astype(np.int64)


def _filter_of(table: pa.Table) -> Cuckoo:
    return Cuckoo.read(table.column("tables").to_pylist()[0]) if table.num_rows else Cuckoo()


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    known = _filter_of(filters).contains(*_pair(keys)) if keys.num_rows else np.zeros(0, bool)
    return keys.select(KEY).append_column("known", pa.array(known))


def _change(changes: pa.Table, filters: pa.Table) -> pa.Table:
    """The filter of a shard after keys are born (+1) and gone (-1)."""
    found = _filter_of(filters)
    if changes.num_rows:
        h1, h2 = _pair(changes)
        born = changes.column("born").to_numpy(zero_copy_only=False).astype(bool)
        found.delete(h1[~born], h2[~born])
        found.insert(h1[born], h2[born])
    shard = (changes if changes.num_rows else filters).column("shard")[:1]
    return pa.table({"shard": shard, "tables": pa.array([found.written()], FILTER_TYPE)})


FILTER = "shard int, tables array<struct<seats:binary,stash:binary>>"
FILTER_TYPE = pa.list_(pa.struct([("seats", pa.binary()), ("stash", pa.binary())]))


@F.pandas_udf(ArrayType(IntegerType()))
def _kept(h1: pd.Series, h2: pd.Series, drop1: pd.Series, drop2: pd.Series) -> pd.Series:
    """Places of a text's lines that are not among the dropped keys; null stays null."""

    def places(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[int] | None:
        if a is None or c is None:
            return None
        gone = set(zip(c.tolist(), d.tolist(), strict=True))
        return [i for i, key in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if key not in gone]

    return pd.Series([places(*x) for x in zip(h1, h2, drop1, drop2, strict=True)], dtype=object)


class LineIndex:
    """Which lines stand in how many documents, for documents that come and go.

    ``key`` and ``text`` name the columns of the documents. Rows that share an id are one
    document, which holds all lines of all of them. Of rows without an id each text is a
    document, less than all that have one (and among themselves by the text's hash). A null text is empty. Keys under ``least`` code points are not indexed.
    Extra columns are not read. All tables are in the shared folder; each method makes the
    next state out of the one before.
    """

    def __init__(self, spark: SparkSession, key: str = "doc_id", text: str = "text", least: int = 20, shards: int | None = None) -> None:
        self.spark, self.key, self.text, self.least, self.shards = spark, key, text, least, shards
        self.refs: list[DataFrame] = []
        self.counts: list[DataFrame] = []
        self.signed = False
        self.filters = spark.createDataFrame([], FILTER)

    # What the index knows

    def references(self, docs: DataFrame) -> DataFrame:
        """(h1, h2, doc, alt): a row for each document and distinct key of at least ``least`` code points."""
        keys = F.transform(F.split(F.coalesce(F.col(self.text), F.lit("")), "\n"), key_of)
        long = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= self.least))
        named = docs.select(*self._names(), self.text)
        rows = named.select(*DOC, F.explode(long).alias("_line")).select(*DOC, *_hashes(F.col("_line")))
        return rows.distinct()

    def _names(self) -> list[Column]:
        unnamed = F.when(F.col(self.key).isNull(), F.xxhash64(F.coalesce(F.col(self.text), F.lit(""))))
        return [F.col(self.key).cast("long").alias("doc"), unnamed.alias("alt")]

    def alive(self, within: DataFrame | None = None) -> DataFrame:
        """(h1, h2, doc, alt) of all documents that are in the index, or of the keys of ``within``."""
        found = _union([r if within is None else r.join(within, KEY, "left_semi") for r in self.refs])
        if not self.signed:
            return found.select(*KEY, *DOC)
        return found.groupBy(*KEY, *DOC).agg(F.sum("sign").alias("sign")).filter("sign > 0").select(*KEY, *DOC)

    def totals(self, within: DataFrame | None = None) -> DataFrame:
        """(h1, h2, n, holder): exact documents of each key and the largest of them; the latest change counts."""
        found = _union([c if within is None else c.join(within, KEY, "left_semi") for c in self.counts])
        if len(self.counts) > 1:
            last = F.max_by(F.struct("n", "holder"), "change").alias("last")
            found = found.groupBy(*KEY).agg(last).select(*KEY, "last.*")
        return found.filter("n > 0").select(*KEY, "n", "holder")

    def _shard(self) -> Column:
        return F.pmod(F.col("h1"), F.lit(self.shards)).cast("int").alias("shard")

    def known(self, keys: DataFrame) -> DataFrame:
        """(h1, h2, known): what the filters say; false is certain, true may be a false alarm."""
        sides = keys.select(*KEY, self._shard()).groupBy("shard"), self.filters.groupBy("shard")
        return sides[0].cogroup(sides[1]).applyInArrow(_probe, "h1 long, h2 long, known boolean")

    # Changes

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents. Lines that a document had before are not counted again."""
        pairs = stored(self.references(docs), "lines-pairs")
        if self.shards is None:
            self.shards = max(8, pairs.count() // SHARD_KEYS + 1)
        mine = pairs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*DOC)).alias("holder"))
        if not self.refs:
            counts = stored(mine.withColumn("change", F.lit(0)), "lines-counts")
            return self._changed(pairs.withColumn("sign", F.lit(1)), counts, counts.select(*KEY, F.lit(True).alias("born")))
        probed = stored(self.known(mine), "lines-known")
        maybe = probed.filter("known").select(*KEY)
        same = self.alive(maybe)
        added = stored(pairs.join(same, _equal(pairs, same, [*KEY, *DOC]), "left_anti"), "lines-added")
        before = self.totals(maybe).select(*KEY, F.col("n").alias("_n"), F.col("holder").alias("_holder"))
        mine = added.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*DOC)).alias("holder"))
        both = mine.join(before, KEY, "left")
        counts = both.select(
            *KEY,
            (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
            F.greatest("holder", "_holder").alias("holder"),
            F.lit(len(self.counts)).alias("change"),
            F.col("_n").isNull().alias("born"),
        )
        counts = stored(counts, "lines-counts")
        found = self._changed(added.withColumn("sign", F.lit(1)), counts.drop("born"), counts.filter("born").select(*KEY, "born"))
        discard(pairs, probed)
        return found

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes the documents out whose ids are in the column ``key`` of ``ids``; others are no error."""
        all_ = self.alive()
        out = ids.select(F.col(self.key).alias("_out")).distinct()
        gone = stored(all_.join(out, all_["doc"].eqNullSafe(out["_out"]), "left_semi").withColumn("sign", F.lit(-1)), "lines-gone")
        touched = gone.select(*KEY).distinct()
        self.refs.append(gone)
        self.signed = True
        left = self.alive(touched).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*DOC)).alias("holder"))
        counts = touched.join(left, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("n"), "holder", F.lit(len(self.counts)).alias("change"))
        counts = stored(counts, "lines-counts")
        self.refs.pop()
        return self._changed(gone, counts, counts.filter("n = 0").select(*KEY, F.lit(False).alias("born")))

    def _changed(self, refs: DataFrame, counts: DataFrame, changes: DataFrame) -> LineIndex:
        self.refs.append(refs)
        self.counts.append(counts)
        sides = changes.select(*KEY, "born", self._shard()).groupBy("shard"), self.filters.groupBy("shard")
        self.filters = stored(sides[0].cogroup(sides[1]).applyInArrow(_change, FILTER), "lines-filters")
        return self

    # What is dropped

    def dropped(self, min_docs: int = 3) -> DataFrame:
        """(doc, alt, drop1, drop2): for each document the keys whose lines go from it.

        Keys of ``min_docs`` documents go from all of them but the one of the largest id.
        """
        frequent = stored(self.totals().filter(F.col("n") >= min_docs), "lines-frequent")
        alive = self.alive()
        total = sum(r.count() for r in self.refs)
        found = hot_join(alive, frequent, KEY, total).filter(~F.struct(*DOC).eqNullSafe(F.col("holder")))
        keys = found.groupBy(*DOC).agg(F.collect_list(F.struct(*KEY)).alias("_keys"))
        return keys.select(*DOC, F.col("_keys.h1").alias("drop1"), F.col("_keys.h2").alias("drop2"))

    def deduplicated(self, docs: DataFrame, min_docs: int = 3) -> DataFrame:
        """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; texts without a dropped line are as they were.

        Columns of these names are replaced, all others stay.
        """
        drop = self.dropped(min_docs).withColumnsRenamed({"doc": "_doc", "alt": "_alt"})
        rest = docs.drop(*({"n_lines", "n_dropped", "kept_text", "_doc", "_alt", "drop1", "drop2", "_places", "_split"} - {self.key, self.text}))
        doc, alt = self._names()
        joined = rest.join(drop, doc.eqNullSafe(drop["_doc"]) & alt.eqNullSafe(drop["_alt"]), "left")
        lines = F.split(F.coalesce(F.col(self.text), F.lit("")), "\n")
        marked = F.col("drop1").isNotNull()
        # Only hashes of texts with dropped keys meet Python; texts stay where they are.
        first, second = (F.when(marked, F.transform(lines, by)) for by in (lambda x: _hashes(key_of(x))[0], lambda x: _hashes(key_of(x))[1]))
        # Lines are a column of their own: a lambda would split the text anew for each of them.
        split = joined.withColumns({"_split": F.when(marked, lines), "n_lines": F.size(lines).cast("long")})
        told = split.withColumn("_places", _kept(first, second, "drop1", "drop2"))
        kept = F.array_join(F.transform("_places", lambda i: F.get("_split", i)), "\n")
        return told.withColumns(
            {
                "n_dropped": F.coalesce(F.size("_split") - F.size("_places"), F.lit(0)).cast("long"),
                "kept_text": F.when(F.col("_split").isNotNull(), kept).otherwise(F.col(self.text)),
            }
        ).drop("_doc", "_alt", "drop1", "drop2", "_places", "_split")


def _equal(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in names))


def _union(tables: list[DataFrame]) -> DataFrame:
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t, allowMissingColumns=True)
    return found
