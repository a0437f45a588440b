"""Secret scans: fixed patterns, and formats learned by grammar inference.

Labelled credentials of one format become a prefix tree of character classes. States
whose futures are statistically compatible (Hoeffding bounds, as in ALERGIA, on what
follows and on how much follows) are merged into a probabilistic automaton, whose
states tell how far a token has come. Every candidate token of a text is scored by the
best automaton's log-likelihood, its end included, against that of the same characters
in plain words; what is likelier as a credential is a span of kind ``format``.

Each format has an automaton, however few its credentials are, and all credentials
together have one more, which knows formats by what they share. The fewer credentials an
automaton was fitted to, the more it has to be ahead of plain words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, texts

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: Tokens that are scored by the automata: all of them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
SPANS = "array<struct<kind:string,start:int,end:int>>"

Span = tuple[int, int, str]
Automaton = dict


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns; offsets in code points, end exclusive."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of hex digits is maximal, so asking for its length here drops the same runs.
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def credential(text: str, span: Span) -> str:
    """The secret part of a base span: the value of an assignment, else all of it."""
    start, end, kind = span
    return ASSIGN.match(text, start, end)[2] if kind == "assign" else text[start:end]


# --- grammar inference -------------------------------------------------------------


def symbol(c: str) -> str:
    """Hex letters, other letters by case, digits; punctuation stands for itself."""
    if "0" <= c <= "9":
        return "d"
    if "a" <= c <= "f":
        return "h"
    if "g" <= c <= "z":
        return "l"
    if "A" <= c <= "F":
        return "H"
    return "L" if "G" <= c <= "Z" else c


#: Characters of each class, so that likelihoods count characters and not classes.
CLASS_SIZE = {"d": 10, "h": 6, "l": 20, "H": 6, "L": 20}


class State:
    __slots__ = ("stops", "visits", "next", "rest")

    def __init__(self) -> None:
        self.stops, self.visits = 0, 0
        #: symbol → [count, target, characters]
        self.next: dict[str, list] = {}
        #: characters that are still to come → samples
        self.rest: Counter = Counter()


def prefix_tree(samples: list[str]) -> State:
    root = State()
    for sample in samples:
        state = root
        for i, c in enumerate(sample):
            state.visits += 1
            state.rest[len(sample) - i] += 1
            edge = state.next.setdefault(symbol(c), [0, State(), Counter()])
            edge[0] += 1
            edge[2][c] += 1
            state = edge[1]
        state.visits += 1
        state.rest[0] += 1
        state.stops += 1
    return root


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return abs(f1 / n1 - f2 / n2) > bound * (n1**-0.5 + n2**-0.5)


def apart(a: State, b: State) -> float:
    """The largest difference of the shares that have no more than some length to come."""
    gap = total = 0.0
    for k in sorted(a.rest.keys() | b.rest.keys()):
        total += a.rest[k] / a.visits - b.rest[k] / b.visits
        gap = max(gap, abs(total))
    return gap


def compatible(a: State, b: State, bound: float) -> bool:
    """Whether the same future may follow both states, to the end of the smaller tree."""
    if apart(a, b) > bound * (a.visits**-0.5 + b.visits**-0.5):
        return False
    work = [(a, b)]
    while work:
        a, b = work.pop()
        if a is b:
            continue
        if _differ(a.stops, a.visits, b.stops, b.visits, bound):
            return False
        for c in a.next.keys() | b.next.keys():
            x, y = a.next.get(c), b.next.get(c)
            if _differ(x[0] if x else 0, a.visits, y[0] if y else 0, b.visits, bound):
                return False
            if x and y:
                work.append((x[1], y[1]))
    return True


def fold(into: State, state: State) -> None:
    """Adds the counts of a tree to a state and, along its symbols, to what follows it."""
    work = [(into, state)]
    while work:
        into, state = work.pop()
        into.stops += state.stops
        into.visits += state.visits
        into.rest.update(state.rest)
        for c, (n, target, chars) in state.next.items():
            if c in into.next:
                into.next[c][0] += n
                into.next[c][2].update(chars)
                work.append((into.next[c][1], target))
            else:
                into.next[c] = [n, target, Counter(chars)]


def infer(samples: list[str], alpha: float = 0.05) -> Automaton:
    """A probabilistic automaton of the samples' format, as plain numbers.

    ``alpha`` is the merge test's error. A state is merged into the compatible one
    whose lengths still to come are most alike, the more visited of equal ones.
    """
    root = prefix_tree(samples)
    alphabet = sorted({symbol(c) for sample in samples for c in sample})
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, blue = [root], [(root, c) for c in sorted(root.next)]
    while blue:
        # The blue state that most samples reach is decided first.
        blue.sort(key=lambda e: (-e[0].next[e[1]][1].visits, e[1]))
        parent, c = blue.pop(0)
        state = parent.next[c][1]
        near = sorted((apart(r, state), -r.visits, i) for i, r in enumerate(red))
        home = next((red[i] for _, _, i in near if compatible(red[i], state, bound)), None)
        if home is not None:
            parent.next[c][1] = home
            fold(home, state)
        else:
            red.append(state)
        known = {id(r) for r in red}
        blue = [(r, x) for r in red for x in sorted(r.next) if id(r.next[x][1]) not in known]
    number = {id(r): i for i, r in enumerate(red)}
    edges = [_emissions(r, alphabet, number) for r in red]
    return {
        "edges": edges,
        "ceiling": max((e[0] for state in edges for e in state.values()), default=-math.inf),
        "stop": [math.log((r.stops + 0.01) / (r.visits + 1.01)) for r in red],
        "states": len(red),
        "samples": len(samples),
    }


def _emissions(state: State, alphabet: list[str], number: dict[int, int]) -> dict[str, tuple[float, int]]:
    """Character → (log-likelihood, next state), for all of the format's classes.

    A class that the state never saw shares one sample with the other classes, and
    leads where most samples went; a character shares one with those of its class.
    """
    out: dict[str, tuple[float, int]] = {}
    if not state.next:
        return out
    main = number[id(max(state.next.values(), key=lambda e: e[0])[1])]
    for c in alphabet:
        n, target, chars = state.next.get(c, (0, None, {}))
        of_class = math.log((n + 1 / len(alphabet)) / (state.visits + 1.01))
        for x in CHARACTERS.get(c, c):
            share = (chars.get(x, 0) + 1 / CLASS_SIZE.get(c, 1)) / (n + 1)
            out[x] = (of_class + math.log(share), main if target is None else number[id(target)])
    return out


CHARACTERS = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}


def likelihood(automaton: Automaton, token: str) -> float:
    """Log-likelihood of a token and its end, per character; -inf of what is no such format."""
    edges, state, total = automaton["edges"], 0, 0.0
    for c in token:
        edge = edges[state].get(c)
        if edge is None:
            return -math.inf
        total += edge[0]
        state = edge[1]
    return (total + automaton["stop"][state]) / len(token)


#: Of a pair of characters that plain words never have.
UNSEEN = math.log(1e-4)


def plain_model(counts: dict[str, int]) -> dict[str, float]:
    """Log-probability of each character after another in plain words, add-half smoothed."""
    before = Counter()
    for pair, n in counts.items():
        before[pair[0]] += n
    return {p: math.log((n + 0.5) / (before[p[0]] + 35.0)) for p, n in counts.items()} | {
        c: math.log(0.5 / (n + 35.0)) for c, n in before.items()
    }


def plain_likelihood(model: dict[str, float], token: str) -> float:
    total, last = 0.0, " "
    for c in token:
        total += model.get(last + c, model.get(last, UNSEEN))
        last = c
    return total / len(token)


# --- over tables -------------------------------------------------------------------


#: Characters of a credential that an automaton takes at most.
LONGEST = 512
#: The automaton of all credentials, beside those of the formats.
POOLED = "all formats"
#: By how much, shared by the credentials of an automaton, the margin is wider.
WIDER = 2.0


def alphabet_of(value: str) -> str:
    """The format's name: which of digits, letters by case and signs a credential uses."""
    found = {symbol(c) for c in value}
    signs = "".join(sorted(c for c in found if c not in CLASS_SIZE))
    lower = "lower" if "l" in found else "hex" if "h" in found else ""
    upper = "UPPER" if "L" in found else "HEX" if "H" in found else ""
    return "-".join(x for x in ("digits" * ("d" in found), lower, upper, signs) if x)


def labelled_credentials(docs: DataFrame, text: str = "text", each: int = 2000) -> dict[str, list[str]]:
    """At most ``each`` distinct credentials of each base kind, by format.

    The labels are the base patterns' kinds; of each, the credentials with least hash
    are taken, of up to LONGEST characters, whole. The bounds are on what the automata
    are fitted to; nothing else is sampled.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[str, str], None] = {}
            for t in texts(batch.column(0)):
                best.update({(s[2], v): None for s in base_spans(t) if len(v := credential(t, s)) <= LONGEST})
            if best:
                kinds, values = zip(*best)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values)], ["kind", "value"])

    found = stored(docs.select(text).mapInArrow(find, "kind string, value string").distinct(), "credentials")
    # Each kind's least hashes: a bounded top list, kept bounded before it is sent.
    parts = [
        found.filter(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(each) for k in KINDS[:3]
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).collect()
    discard(found)
    formats: dict[str, list[str]] = {}
    for value in sorted({r["value"] for r in rows}):
        formats.setdefault(alphabet_of(value), []).append(value)
    return dict(sorted(formats.items()))


#: Characters of the longest word with letters and digits that counts as plain.
PLAIN = 16


def plain_pairs(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Counts of adjacent ASCII characters in plain words: at most 96 by 96 numbers.

    Words of more than PLAIN characters that mix letters and digits are no plain words:
    credentials that nothing labels would else teach the model what they are told from.
    """
    ascii_text = F.coalesce(F.col(text), F.lit(""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(128 * 128, np.int64)
        for batch in batches:
            for t in texts(batch.column(0)):
                codes = np.frombuffer(t.encode("ascii", "replace"), np.uint8).astype(np.int32)
                codes[codes < 33] = 32
                word = np.cumsum(codes == 32)
                digit, letter = (codes >= 48) & (codes <= 57), ((codes | 32) >= 97) & ((codes | 32) <= 122)
                inside = np.bincount(word, codes != 32), np.bincount(word, digit), np.bincount(word, letter)
                codes[((inside[0] > PLAIN) & (inside[1] > 0) & (inside[2] > 0))[word]] = 32
                total += np.bincount(codes[:-1] * 128 + codes[1:], minlength=128 * 128)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    rows = docs.select(ascii_text).mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n")).collect()
    return {chr(p // 128) + chr(p % 128): n for p, n in rows if p % 128 != 32}


#: Errors of the merge test that are tried; a small one merges more.
ALPHAS = (0.0001, 0.01, 0.3)


def fitted(samples: list[str]) -> Automaton:
    """The automaton whose merge test gives held-out samples the best mean likelihood.

    Every fifth sample by hash is held out; the automaton is then fitted to all.
    """
    order = sorted(samples, key=lambda x: hashlib.sha256(x.encode()).digest())
    held, rest = order[::5], [x for i, x in enumerate(order) if i % 5]

    def mean(alpha: float) -> float:
        automaton = infer(rest, alpha)
        return sum(max(likelihood(automaton, x), 10 * UNSEEN) for x in held) / len(held)

    return infer(samples, max(ALPHAS, key=mean))


def learn(docs: DataFrame, text: str = "text", each: int = 2000) -> dict:
    """The automata of all labelled formats, the one of all of them, and the model of plain words.

    Without a labelled credential there is no automaton, and nothing to find by them.
    """
    formats = labelled_credentials(docs, text, each)
    automata = {k: fitted(v) for k, v in formats.items()}
    if len(formats) > 1:
        automata[POOLED] = fitted(sorted(x for v in formats.values() for x in v))
    return {"automata": automata, "plain": plain_model(plain_pairs(docs, text))}


def ahead(automaton: Automaton, token: str, plain: float, margin: float) -> bool:
    """Whether a token is likelier in a format than in plain words, by a margin that narrows with the samples."""
    least = plain + margin + WIDER / automaton["samples"]
    # No token of a format is likelier than its likeliest characters.
    return automaton["ceiling"] > least and likelihood(automaton, token) > least


#: Verdicts that a task keeps: words come again and again.
REMEMBERED = 100_000


def learned_spans(text: str, model: dict, taken: list[Span], margin: float, told: dict[str, bool] | None = None) -> list[Span]:
    """Candidates that some format explains better by ``margin``, a character on average.

    A token that lies in one of the ``taken`` spans, sorted by start, is one already.
    Every other is scored whole. ``told`` keeps verdicts of this model and margin.
    """
    told = {} if told is None else told
    found, plain, automata = [], model["plain"], list(model["automata"].values())
    next_taken, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while next_taken < len(taken) and taken[next_taken][0] <= start:
            reach = max(reach, taken[next_taken][1])
            next_taken += 1
        # A full stop or dash at the end belongs to the sentence.
        token = m[0].rstrip(".-")
        end = start + len(token)
        if not token or end <= reach:
            continue
        if token not in told:
            if len(told) >= REMEMBERED:
                told.clear()
            base = plain_likelihood(plain, token)
            told[token] = any(ahead(a, token, base, margin) for a in automata)
        if told[token]:
            found.append((start, end, "format"))
    return found


def find_secrets(docs: DataFrame, model: dict, text: str = "text", margin: float = 0.5) -> DataFrame:
    """``docs`` with ``secrets``: (kind, start, end), by start, then kind as listed.

    Offsets are code points, the end exclusive. The spans of the base patterns are
    always there; ``format`` spans lie in none of them. A null text is empty and has none.
    One row for each row of ``docs``; a column ``secrets`` is replaced. Whole texts
    are scanned, one at a time.
    """
    docs = docs.drop(*(["secrets"] if text != "secrets" else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the samples fitted
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for t in texts(batch.column(text)):
                base = base_spans(t)
                spans = sorted(base + learned_spans(t, shared.value, base, margin, told), key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, shape)], [*batch.schema.names, "secrets"])

    schema = docs.limit(0).withColumn("secrets", F.lit(None).cast(SPANS)).schema
    return docs.mapInArrow(scan, schema)


def redacted(text: str, spans: list[dict]) -> str:
    """``text`` with ``[SECRET]`` for each run of overlapping spans, which are sorted by start."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], "[SECRET]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """Puts ``[SECRET]`` for each run of overlapping spans in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            column = batch.column(at)
            spans = batch.column(batch.schema.get_field_index(secrets)).to_pylist()
            made = [t if not s else redacted(t, s) for t, s in zip(column.to_pylist(), spans)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, column.type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: str, base_only: bool):  # noqa: ANN201
    """``kind:start:end`` of the spans, comma-joined, as a column."""
    kept = F.filter(spans, lambda x: x["kind"] != KINDS[3]) if base_only else F.col(spans)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(text: str) -> str:
    """The base spans of one text as the query digests them, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base_spans(text)).encode()).hexdigest()
