"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens. All pre-tokens of a batch that are not known yet lie
as symbols in one flat array with row offsets. In each round every row finds its
lowest-ranked adjacent pair and merges all its places at once; rows without a
mergeable pair leave. The symbols that survive are the tokens.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain, count, groupby, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts

NO_RANK = np.iinfo(np.int64).max
#: Pre-tokens whose counts a worker remembers; past that it starts anew.
KNOWN = 600_000
#: Texts whose new pre-tokens are merged together, and their characters, or one longer.
TEXTS, CHARS = 256, 4_000_000
#: By pre-token pattern: one for ``re`` that cuts texts without odd characters alike.
QUICK = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": (
        r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
    )
}
#: The printable stand-ins of byte-level vocabularies: bytes that print as themselves.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself, or from U+0100 on in order."""
    hidden = [b for b in range(256) if b not in set(PRINTABLE)]
    return [chr(b) if b not in hidden else chr(256 + hidden.index(b)) for b in range(256)]


class MergeTable:
    """A byte-level BPE vocabulary as arrays: pair → rank and merged symbol."""

    @classmethod
    def read(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        table = cls()
        vocab = model["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        table.size = len(vocab)
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        keys = left * table.size + right
        order = np.argsort(keys, kind="stable")
        table.keys, table.ranks = keys[order], order
        table.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        table.byte_ids = np.array([vocab[c] for c in byte_symbols()], np.int64)
        ids = table.byte_ids
        table.byte_ranks = table.rank(np.repeat(ids, 256), np.tile(ids, 256)).reshape(256, 256)
        table.special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        return table

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece of one byte or more."""
        out = np.zeros(len(pieces), np.int64)
        rows = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        plain = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.byte_ids[plain]
        # ranks[i]: of the pair of symbols i and i + 1; none at a row's last symbol.
        ranks = np.full(len(rows), NO_RANK)
        if len(rows):
            ranks[:-1] = np.where(rows[1:] == rows[:-1], self.byte_ranks[plain[:-1], plain[1:]], NO_RANK)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(rows)])
            done = best == NO_RANK
            if done.any():
                out[rows[starts[done]]] = sizes[done]
                going = np.repeat(~done, sizes)
                symbols, rows, ranks = symbols[going], rows[going], ranks[going]
                best, sizes = best[~done], sizes[~done]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(best, sizes)
            # Of places that overlap, as in "aaa", every second one from the left counts.
            chained = hit.copy()
            chained[0] = False
            chained[1:] &= hit[:-1]
            if chained.any():
                index = np.arange(len(hit))
                run_start = np.maximum.accumulate(np.where(hit & ~chained, index, 0))
                hit &= (index - run_start) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[ranks[at]]
            stay = np.ones(len(hit), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            symbols, rows, ranks = symbols[stay], rows[stay], ranks[stay]
            # Only pairs that hold a merged symbol have a new rank.
            at = place[at]
            at = np.unique(np.r_[at, at[at > 0] - 1])
            inner = np.zeros(len(at), bool)
            has_next = at + 1 < len(rows)
            inner[has_next] = rows[at[has_next]] == rows[at[has_next] + 1]
            ranks[at[~inner]] = NO_RANK
            at = at[inner]
            ranks[at] = self.rank(symbols[at], symbols[at + 1])
        return out


class Ids(dict):
    """Numbers its keys as they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def odd_characters() -> str:
    """What ``re`` and the vocabulary's pattern class differently, as a pattern."""
    odd = [
        i
        for i in range(sys.maxunicode + 1)
        if 0x1C <= i <= 0x1F
        or (c := chr(i)).isalnum()
        and (k := unicodedata.category(c))[0] != "L"
        and k != "Nd"
    ]
    runs = [list(g) for _, g in groupby(odd, key=lambda i, n=count(): i - next(n))]
    return "[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs) + "]"


def parts(batch: list[str]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of at most TEXTS texts and CHARS characters; a longer text is alone."""
    first = size = 0
    for i, t in enumerate(batch):
        if i > first and (i - first == TEXTS or size + len(t) > CHARS):
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(batch):
        yield first, len(batch)


class Counter:
    """Counts tokens of texts, remembering the pre-tokens it has met."""

    def __init__(self, table: MergeTable, pattern: str):
        self.table = table
        self.cut = regex.compile(pattern).findall
        #: A text without odd characters is cut by the faster engine, to the same pieces.
        self.quick = re.compile(QUICK[pattern]).findall if pattern in QUICK else None
        self.odd = re.compile(odd_characters()).search if self.quick else None
        specials = "|".join(regex.escape(x) for x in self.table.special)
        self.special = regex.compile(specials) if specials else None
        self.known, self.sizes = Ids(), np.zeros(0, np.int64)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings; these split the text."""
        cut = self.quick if self.quick and not self.odd(text) else self.cut
        if self.special is None or not any(x in text for x in self.table.special):
            return cut(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in cut(part)], len(parts) - 1

    def __call__(self, batch: list[str]) -> list[int]:
        out = np.zeros(len(batch), np.int64)
        for i, end in parts(batch):
            if len(self.known) > KNOWN:
                self.known, self.sizes = Ids(), self.sizes[:0]
            found = [self.pieces(t) for t in batch[i:end]]
            ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(p for p, _ in found)), np.int64)
            new = [p.encode() for p in islice(self.known, len(self.sizes), None)]
            self.sizes = np.r_[self.sizes, self.table.counts(new)]
            sizes = np.r_[0, np.cumsum(self.sizes[ids])]
            ends = np.cumsum([len(p) for p, _ in found])
            out[i:end] = np.diff(np.r_[0, sizes[ends]]) + [n for _, n in found]
        return out.tolist()


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is the path of a byte-level BPE file, which the driver reads,
    ``pattern`` its pre-token pattern. Strings of the vocabulary's special tokens
    inside a text are one token each, as the file's library counts them; none are
    added. One row for each row of ``docs``; columns of the same name as an added one
    are replaced. A null text is empty: no bytes, no tokens. Whole texts are counted;
    a batch holds as many rows as arrow gives it, its merges ``TEXTS`` texts and ``CHARS``
    characters at a time.
    """
    added = ["n_bytes", "n_tokens", "over_limit"]
    kept = docs.drop(*(c for c in added if c != text))
    rest = [c for c in kept.columns if c != text]

    # The vocabulary's arrays: their size is that of the file, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(vars(MergeTable.read(vocabulary)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = MergeTable()
        vars(merges).update(shared.value)
        counter = Counter(merges, pattern)
        for batch in batches:
            n = counter(texts(batch.column(len(rest))))
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], [*rest, "n_tokens"])

    schema = T.StructType([*(kept.schema[c] for c in rest), T.StructField("n_tokens", T.LongType())])
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    rest += ["n_bytes"]
    schema = T.StructType([*schema.fields[:-1], T.StructField("n_bytes", T.LongType()), schema.fields[-1]])
    return (
        kept.withColumn("n_bytes", size)
        .select(*rest, text)
        .mapInArrow(count, schema)
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
