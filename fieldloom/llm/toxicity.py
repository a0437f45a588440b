"""Toxicity by multiple-instance learning from document labels.

A document is a bag of sentences. Each sentence has a logistic score over its words;
a word's weight is the sum of hashed weights of the word and of its beginnings
and ends, so that unseen forms of a known stem count. A document's score is the
noisy-or of its sentences, and the weights are trained through it from document labels
alone. The same sentence scores then tell where a text offends.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, texts

BITS = 18
#: Training documents that a feature needs.
MIN_DOCS = 8
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
#: Words whose weights a worker remembers; past that it starts anew.
KNOWN = 300_000
SPANS = "array<struct<start:int,end:int,score:float>>"


def features(word: str) -> list[int]:
    """Hashed ids of a word, and of its first and last 3 to 6 characters."""
    marked = f"<{word}>"
    grams = {marked} | {x for n in (4, 5, 6, 7) for x in (marked[:n], marked[-n:])}
    return [zlib.crc32(g.encode("utf-8", "replace")) >> (32 - BITS) for g in sorted(grams)]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence that has words."""
    found = []
    for m in SENTENCE.finditer(text):
        own = WORD.findall(m[0].lower())
        if own:
            found.append((m.start(), m.end(), own))
    return found


class Bags:
    """Training documents as flat arrays: document → sentence → word → feature."""

    def __init__(self, documents: list[str]):
        vocabulary: dict[str, int] = {}
        words, sentence_sizes, bag_sizes = [], [], []
        for text in documents:
            found = sentences(text)
            bag_sizes.append(len(found))
            for _, _, own in found:
                # A word counts once in a sentence.
                own = set(own)
                sentence_sizes.append(len(own))
                words += [vocabulary.setdefault(w, len(vocabulary)) for w in own]
        self.words = np.array(words, np.int32)
        self.sentence_of = np.repeat(np.arange(len(sentence_sizes)), sentence_sizes)
        self.bag_of = np.repeat(np.arange(len(documents)), bag_sizes)
        grams = [features(w) for w in vocabulary]
        self.grams = np.array([g for own in grams for g in own], np.int32)
        self.word_of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        # Documents of a feature, as the sum over its words: rare ones are not learned,
        # for they would only remember single documents.
        pairs = np.unique(self.bag_of[self.sentence_of] * np.int64(len(grams)) + self.words)
        word_docs = np.bincount(pairs % max(len(grams), 1), minlength=len(grams))
        self.common = np.bincount(self.grams, word_docs[self.word_of], 1 << BITS) >= MIN_DOCS
        self.n_words, self.n_sentences, self.n_bags = len(vocabulary), len(sentence_sizes), len(documents)


#: What is added to a log of zero's place.
TINY = 1e-12


def train(documents: list[str], labels: np.ndarray, steps: int = 100, rate: float = 1.0, decay: float = 1e-4) -> dict:
    """Weights and bias that make the noisy-or fit the documents' labels.

    Gradient descent on the mean log losses of both classes, in which clean documents weigh three
    times as much as toxic ones; weights are decayed. With one class only, or no documents, the model scores that class's rate.
    """
    weights = np.zeros(1 << BITS, np.float64)
    positive = float(labels.mean()) if len(labels) else 0.0
    if positive in (0.0, 1.0):
        return {"weights": weights.astype(np.float32), "bias": 30.0 if positive else -30.0}
    bags = Bags(documents)
    share = np.where(labels == 1, 0.25 / labels.sum(), 0.75 / (labels == 0).sum())
    bias, move = -6.0, np.zeros(len(weights) + 1)
    for _ in range(steps):
        word_weight = np.bincount(bags.word_of, weights[bags.grams], bags.n_words)
        z = bias + np.bincount(bags.sentence_of, word_weight[bags.words], bags.n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # log(1 - P) of a bag is the sum over its sentences: the noisy-or.
        none = np.bincount(bags.bag_of, np.log1p(-np.minimum(p, 1 - TINY)), bags.n_bags)
        some = -np.expm1(none)
        # d loss / d z of a sentence: p for a clean bag, -p (1 - P) / P for a toxic one.
        pull = share * np.where(labels == 1, -np.exp(none) / np.maximum(some, TINY), 1.0)
        dz = pull[bags.bag_of] * p
        d_word = np.bincount(bags.words, dz[bags.sentence_of], bags.n_words)
        d = bags.common * np.bincount(bags.grams, d_word[bags.word_of], len(weights)) + decay * weights
        # Momentum, not step sizes per weight: words that many documents agree on move
        # far, words of a few documents hardly.
        move = 0.9 * move + np.append(d, 0.1 * dz.sum())
        weights -= rate * move[:-1]
        bias -= rate * move[-1]
    return {"weights": weights.astype(np.float32), "bias": float(bias)}


class Weights(dict):
    """Word → weight, worked out as words are first met."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > KNOWN:
            self.clear()
        self[word] = w = float(self.weights[features(word)].sum())
        return w


class Scorer:
    """Scores sentences and texts."""

    def __init__(self, model: dict):
        self.weight, self.bias = Weights(model["weights"]).__getitem__, model["bias"]

    def sentence(self, own: list[str]) -> float:
        z = self.bias + sum(map(self.weight, set(own)))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

    def text(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or, and the sentences that are likelier toxic than not."""
        rest, found = 1.0, []
        for start, end, own in sentences(text):
            p = self.sentence(own)
            rest *= 1 - p
            if p >= 0.5:
                found.append((start, end, p))
        return 1 - rest, found


def training_rows(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, each: int, chars: int
) -> list[tuple[str, int]]:
    """At most ``each`` labelled texts of each class, those whose keys hash least.

    Rows are held out by key (see ``held_out``). A key that is repeated stands for its
    text of least hash, and is toxic if any of its labels is. ``chars`` bounds the text
    of each class: texts are taken whole, in hash order; one that does not fit is left
    out and the next is tried. A class of which no text fits is an error.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
        .groupBy(key)
        .agg(F.max(label).alias("_label"))
    )
    parts = [known.filter(F.col("_label") == c).orderBy(F.xxhash64(key), key).limit(each) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select(F.col(key).alias("_key"), "_label")
    # At most twice ``each`` ids: a proven bound. Repeated rows of an id meet in pieces.
    rows = (
        docs.join(F.broadcast(chosen), F.col(key) == F.col("_key"))
        .filter(F.col(text).isNotNull())
        .groupBy("_key", "_label")
        .agg(F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"))).alias("_least"))
        .select("_key", "_label", F.col("_least.t").alias("_text"))
    )
    rows = stored(rows.withColumns({"_size": F.length("_text"), "_order": F.xxhash64("_key")}), "labelled")
    room, taken = {0: chars, 1: chars}, []
    found = rows.select("_order", "_key", "_label", "_size").collect()
    for r in sorted(found):
        if r["_size"] <= room[r["_label"]]:
            room[r["_label"]] -= r["_size"]
            taken.append(r["_key"])
    for c in (0, 1):
        if room[c] == chars and any(r["_label"] == c and r["_size"] for r in found):
            raise ValueError(f"no labelled text of class {c} has at most {chars} characters")
    texts_of = {r["_key"]: (r["_text"], r["_label"]) for r in rows.filter(F.col("_key").isin(taken)).collect()}
    discard(rows)
    return [texts_of[k] for k in sorted(taken)]


def held_out(key):  # noqa: ANN001, ANN201
    """Whether a row's labels are never learned by this rule; a null key has no labels, and is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    each: int = 2500,
    chars: int = 20_000_000,
) -> dict:
    """The model, from a bounded sample of the labelled rows that are not held out."""
    rows = training_rows(docs.select(key, text), labels, key, text, label, each, chars)
    return train([t for t, _ in rows], np.array([y for _, y in rows], np.int64))


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``offending`` sentences' spans.

    The score reads the text only. A null or empty text has no sentence: its score is
    0. One row for each row of ``docs``; columns of the same name as an added one are
    replaced. Whole texts are scored, sentence by sentence.
    """
    docs = docs.drop(*(c for c in ("score", "predicted", "offending") if c != text))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            done = [scorer.text(t) for t in texts(batch.column(text))]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in done]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["score"] = pa.array([p for p, _ in done], pa.float64())
            columns["offending"] = pa.array(spans, shape)
            del columns[text]
            yield pa.RecordBatch.from_pydict(columns)

    added = {"score": F.lit(0.0), "offending": F.lit(None).cast(SPANS)}
    schema = docs.drop(text).limit(0).withColumns(added).schema
    done = docs.mapInArrow(run, schema)
    return done.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
