"""Language-model scores by cross-entropy difference.

Two bigram models share one vocabulary, its order, its smoothing and its table: the
target model is counted over the documents of a target set, the background model over
all. A document's score is its mean loss per token under the target model less that
under the background model: lower is nearer to the target.

The vocabulary is open and nothing is folded together: words and bigrams are counted by
64-bit hashes in a distributed table that grows with the corpus. Documents are dealt to
groups of some MB. A group sends each of its distinct words and bigrams once, with its
counts, to one of as many buckets of hashes; the bucket sums over all groups and answers
each in its own order, so that a hot word is one row of a group. The start of a text
counts as a word before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts

#: Interpolation: weight of the bigram's share; the rest is the word's own.
PAIR_WEIGHT = 0.7
#: Bytes of text of a group, and of the text whose words a bucket counts.
GROUP_BYTES = 12 << 20
#: Tokens that are looked up at once.
STEP = 1 << 18
#: The hash of the start of a text.
START = 0x5EED0F7E47
ASKED = "_group bigint, _bucket bigint, words binary, pairs binary, counts binary"
ANSWERED = "_group bigint, _bucket bigint, words binary, pairs binary, totals binary"


def _distinct(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


class Vocabulary(dict):
    """Word → its number in a group; number 0 is the start of a text."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = [START]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        return number


def pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (after * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


def packed(numbers: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers by ``width`` planes of bytes, of which most are zeros and cost nothing."""
    return np.ascontiguousarray(numbers.astype(f"<i{width}").reshape(-1).view(np.uint8).reshape(-1, width).T).tobytes()


def unpacked(raw: bytes, width: int = 8) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<i{width}").reshape(-1)


def _released(table: pa.Table) -> pa.Table:
    """``table``, when what Arrow holds in reserve has gone back: workers live on, beside others."""
    pa.default_memory_pool().release_unused()
    return table


class Group:
    """Words and bigrams of some texts: each token's, and the distinct ones in buckets.

    Numbers inside a group, which has some MB of text, are of 32 bits.
    """

    def __init__(self, texts: Iterator[bytes], buckets: int) -> None:
        vocabulary, own = Vocabulary(), []
        for text in texts:
            # Words are lower-cased in ASCII.
            found = text.lower().split()
            own.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.words = np.concatenate(own) if own else np.zeros(0, np.int32)
        del own
        self.ends = np.cumsum(self.sizes)
        hashes = np.array(vocabulary.hashes, np.uint64)
        del vocabulary
        keys = np.zeros(len(self.words), np.int64)
        keys[1:] = self.words[:-1]
        keys[(self.ends - self.sizes)[self.sizes > 0]] = 0
        keys *= len(hashes)
        keys += self.words
        distinct = _distinct(np.sort(keys))
        self.pairs = np.empty(len(keys), np.int32)
        for at in range(0, len(keys), STEP):
            self.pairs[at : at + STEP] = np.searchsorted(distinct, keys[at : at + STEP])
        del keys
        #: The words of each distinct bigram.
        self.first, self.second = ((f(distinct, len(hashes))).astype(np.int32) for f in (np.floor_divide, np.remainder))
        del distinct
        self.word_blocks = self._blocks(hashes, buckets)
        self.pair_blocks = self._blocks(pair_hashes(hashes[self.first], hashes[self.second]), buckets)

    @staticmethod
    def _blocks(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes by bucket, their order, and where each bucket begins and ends in it."""
        bucket = ((hashes >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((hashes, bucket)).astype(np.int32)
        return hashes[order], order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def counts(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(target, background) of each word and of each bigram; ``flags`` are the texts'."""
        hit = np.repeat(flags, self.sizes)
        begun = self.sizes > 0
        words, pairs = (np.zeros((2, len(b[1])), np.int32) for b in (self.word_blocks, self.pair_blocks))
        for k, (tokens, texts) in enumerate(((hit, begun & flags), (slice(None), begun))):
            words[k] = np.bincount(self.words[tokens], minlength=words.shape[1])
            words[k, 0] = texts.sum()
            pairs[k] = np.bincount(self.pairs[tokens], minlength=pairs.shape[1])
        return words, pairs


def asked(table: pa.Table, text: str, flags: np.ndarray, counted: bool, buckets: int) -> pa.Table:
    """What a group of rows sends to each bucket: hashes of words and bigrams, and counts.

    Rows that are not of the corpus are not ``counted``: they only ask.
    """
    number = table.column("_group")[0].as_py()
    own = Group((x for c in table.column(text).chunks for x in raw_texts(c)), buckets)
    words, pairs = own.counts(flags)
    if not counted:
        words, pairs = words * 0, pairs * 0
    (wh, wo, wa), (ph, po, pa_) = own.word_blocks, own.pair_blocks
    words, pairs = words[:, wo], pairs[:, po]
    del own, wo, po
    made = []
    for b in range(buckets):
        w, p = slice(wa[b], wa[b + 1]), slice(pa_[b], pa_[b + 1])
        counts = np.concatenate([words[0, w], words[1, w], pairs[0, p], pairs[1, p]])
        made.append((number, b, wh[w].tobytes(), ph[p].tobytes(), packed(counts, 4)))
    return _released(_rows(made, ASKED))


def _rows(made: list[tuple], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in made], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def answered(table: pa.Table) -> pa.Table:
    """A bucket's sums, for each group whose documents are scored in the order it asked.

    ``totals`` are the bucket's tokens of both models and its words that are used.
    """
    groups = table.column("_group").to_pylist()
    sums, totals = {}, []
    counts = [unpacked(x.as_py(), 4) for x in table.column("counts")]
    sizes = [len(x.as_py()) // 8 for x in table.column("words")]
    for k in ("words", "pairs"):
        blocks = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(k)]
        ends = np.cumsum([len(x) for x in blocks])
        hashes = np.concatenate(blocks)
        del blocks
        distinct = _distinct(np.sort(hashes))
        at = np.empty(len(hashes), np.int32)
        for start in range(0, len(hashes), STEP):
            at[start : start + STEP] = np.searchsorted(distinct, hashes[start : start + STEP])
        used = len(distinct)
        del hashes, distinct
        parts = [c[: 2 * n] if k == "words" else c[2 * n :] for c, n in zip(counts, sizes)]
        total = np.zeros((2, used), np.int64)
        for i in range(2):
            every = np.concatenate([p.reshape(2, -1)[i] for p in parts])
            # Sums of whole numbers below 2⁵³: exact as doubles.
            total[i] = np.bincount(at, every, used).astype(np.int64)
        del parts, every
        if k == "words":
            totals = [*total.sum(1), (total[1] > 0).sum()]
        # A group's answers are packed by themselves: bytes, most of them zeros, in the order it asked.
        sums[k] = [packed(total[:, own]) if g >= 0 else b"" for g, own in zip(groups, np.split(at, ends[:-1]))]
    del counts
    bucket = table.column("_bucket")[0].as_py()
    whole = packed(np.array(totals, np.int64))
    made = [(g, bucket, w, p, whole) for g, w, p in zip(groups, sums["words"], sums["pairs"]) if g >= 0]
    return _released(_rows(made, ANSWERED))


def losses(own: Group, answers: pa.Table) -> np.ndarray:
    """Loss in nats of each token (columns) under both models (rows).

    The background is scaled to the target's number of tokens, so that both models
    smooth alike: add one over the words that the corpus uses. A bigram's share is its
    count over that of its first word.
    """
    buckets = answers.column("_bucket").to_pylist()
    places = sorted(range(len(buckets)), key=buckets.__getitem__)
    whole = sum(unpacked(x.as_py()) for x in answers.column("totals"))
    found = []
    for k, (_, order, ends) in (("words", own.word_blocks), ("pairs", own.pair_blocks)):
        counts, column = np.empty((2, len(order))), answers.column(k)
        for b, i in enumerate(places):
            counts[:, order[ends[b] : ends[b + 1]]] = unpacked(column[i].as_py()).reshape(2, -1)
        found.append(counts)
    (words, pairs), tokens, used = found, whole[:2].astype(float), max(int(whole[2]), 1)
    if tokens[0] and tokens[1]:
        scale = tokens[0] / tokens[1]
        words[1] *= scale
        pairs[1] *= scale
        tokens[1] *= scale
    alone = (words + 1) / (tokens[:, None] + used)
    out = np.empty((2, len(own.words)))
    for k in range(2):
        # A loss is its bigram's: each distinct one is computed once.
        of = words[k][own.first]
        share = np.divide(pairs[k], of, out=np.zeros_like(of), where=of > 0)
        share *= PAIR_WEIGHT
        share += (1 - PAIR_WEIGHT) * alone[k][own.second]
        np.take(-np.log(share), own.pairs, out=out[k])
    return out


def fit(docs: DataFrame, text: str = "text", is_target: str = "is_target") -> DataFrame:
    """The models' corpus: its texts, and which are the target. Null is not the target.

    Counting is left to where documents are scored, as the counts grow with the corpus.
    """
    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(is_target).cast("boolean"), F.lit(False)).alias("is_target"))


def cross_entropy_difference(docs: DataFrame, m: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without text, with ``n_tokens``, both mean losses and ``score``.

    ``m`` is what ``fit`` gives. ``score`` is the mean of the tokens' differences of
    losses. A null text, or one without words, has no tokens: its losses and score are 0.
    One row for each row of ``docs``; columns of the same name as an added one are replaced.
    """
    docs, rest = _kept(docs, text)
    groups = _groups(_bytes(docs, text) + _bytes(m, "text"))
    rows = _dealt(docs, rest, text, groups)
    # Groups of the corpus have negative numbers: they are counted, and not answered.
    corpus = m.select("text", "is_target", (-1 - F.pmod(F.xxhash64("text"), F.lit(groups))).alias("_group"))
    asking = rows.select(F.col(text).alias("text"), F.lit(False).alias("is_target"), "_group").unionByName(corpus)

    def ask(table: pa.Table) -> pa.Table:
        flags = np.array(table.column("is_target").to_pylist(), bool)
        return asked(table, "text", flags, table.column("_group")[0].as_py() < 0, groups)

    return _scored(rows, asking.groupBy("_group").applyInArrow(ask, ASKED), rest, text, groups)


def cross_entropy_of_corpus(docs: DataFrame, targets: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``cross_entropy_difference`` of ``docs`` under models fitted to ``docs`` themselves.

    ``targets`` has the keys of the target set. Texts are dealt once, for counting and
    for scoring: what meets the targets is keys and numbers of groups, without text.
    """
    docs, rest = _kept(docs, text)
    groups = _groups(_bytes(docs, text))
    rows = _dealt(docs, rest, text, groups)
    # Keys grow with the documents: the plan that holds at scale, at every size.
    of = rows.select(F.col(key).alias("_key"), F.col("_group").alias("_of"))
    hits = of.join(targets.select(F.col(key).alias("_key")).hint("merge"), "_key", "left_semi").distinct()

    def ask(table: pa.Table, hits: pa.Table) -> pa.Table:
        flags = pc.is_in(table.column(key), value_set=hits.column("_key").combine_chunks())
        return asked(table, text, np.array(flags.to_pylist(), bool), True, groups)

    asking = rows.groupBy("_group").cogroup(hits.groupBy("_of")).applyInArrow(ask, ASKED)
    return _scored(rows, asking, rest, text, groups)


ADDED = ["n_tokens", "target_loss", "background_loss", "score"]


def _kept(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    docs = docs.drop(*(c for c in ADDED if c != text))
    return docs, [c for c in docs.columns if c != text]


def _bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def _groups(size: int) -> int:
    return size // GROUP_BYTES + 1


def _dealt(docs: DataFrame, rest: list[str], text: str, groups: int) -> DataFrame:
    """``docs`` with ``_group``: a function of the row, the same on every run of a task.

    Copies of a text are told apart by the other columns.
    """
    plain = [c for c in rest if isinstance(docs.schema[c].dataType, (T.StringType, T.NumericType))]
    return docs.select(*rest, text, F.pmod(F.xxhash64(text, *plain), F.lit(groups)).alias("_group"))


def _scored(rows: DataFrame, asking: DataFrame, rest: list[str], text: str, groups: int) -> DataFrame:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Group((x for c in table.column(text).chunks for x in raw_texts(c)), groups)
        out = np.zeros((2, table.num_rows))
        if len(own.words):
            lost, some = losses(own, answers), own.sizes > 0
            out[:, some] = np.add.reduceat(lost, (own.ends - own.sizes)[some], axis=1) / own.sizes[some]
        columns = [*(table.column(c) for c in rest), pa.array(own.sizes), pa.array(out[0]), pa.array(out[1]), pa.array(out[0] - out[1])]
        return _released(pa.table(columns, [*rest, *ADDED]))

    answers = asking.groupBy("_bucket").applyInArrow(answered, ANSWERED)
    fields = [T.StructField("n_tokens", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ADDED[1:]]
    schema = T.StructType([*(rows.schema[c] for c in rest), *fields])
    return rows.groupBy("_group").cogroup(answers.groupBy("_group")).applyInArrow(run, schema)
