"""N-gram Jaccard join by chosen paths.

Sets of word shingles are embedded as tuples of minwise values. A run splits all sets
by a random sample of these shared tokens, each node by its own sample of expected
size 1/similarity, and again inside nodes that stay large; small nodes are compared by
brute force on the sketches. Runs repeat until a pair at the threshold is found with
the target probability. What the sketches link are candidate components only: inside
each, all pairs whose sizes allow the similarity are then verified exactly on the
shingles, block by block.

The first level splits by whole 64-bit tokens, taken where the sets are sketched: sets
that share none leave at once, however many there are. Levels below, of large nodes
only, split by the 16 bits that a sketch keeps.

Sets that are equal are one class before the join, so that no number of copies makes
pairs. Pairs are never emitted: nodes give spanning links, verification gives each
set's number of links and its component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_KEYS, SPACES, discard, hot_join, raw_texts, stored

SHINGLE = 5
#: Minwise values of a sketch.
TOKENS = 128
#: Sets in a node that is compared by brute force: a pair of sketches costs less than
#: the levels that would part them. And sets in a block of verification, and shingles.
SMALL, BLOCK, BLOCK_SHINGLES = 4096, 256, 2_000_000
#: Runs of one pass, and levels after which what stays large is compared in blocks.
RUNS, LEVELS = 3, 12
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; fewer words are one shingle."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - SHINGLE + 1, 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(SHINGLE, len(words))):
            out = mixed(out * MIX + h[i : i + n])
    return np.unique(out)


def permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    a = random.integers(1, 1 << 63, TOKENS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, TOKENS, np.int64).astype(np.uint64)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the set: its tokens, of 64 bits."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(low, (found[i : i + 512, None] * a + b).min(0), out=low)
    return mixed(low)


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame, key: str, text: str, similarity: float, seed: int, recall: float = 0.99) -> DataFrame:
    """(doc_id, text_hash, set_key, size, sketch, heads); the last four null without words.

    ``sketch`` keeps 16 bits of each token, ``heads`` are the set's nodes below the
    roots of the first runs, by whole tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(seed)
        choices = Choices(similarity)
        tops = roots(seed, first_runs(seed, choices, similarity, recall), choices)
        of = np.repeat(tops, [len(choices[int(t)]) for t in tops])
        tokens = np.concatenate([choices[int(t)] for t in tops])
        for batch in batches:
            made = []
            for raw in raw_texts(batch.column(1)):
                found = shingles(raw)
                if len(found):
                    low = minima(found, a, b)
                    drawn = (low >> np.uint64(48)).astype(np.uint16).tobytes()
                    made.append((set_key(found), len(found), drawn, child(of, tokens, low[tokens])))
                else:
                    made.append((None,) * 4)
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            columns = [pa.array(list(x), k) for x, k in zip(zip(*made) if made else [()] * 4, kinds)]
            names = ["doc_id", "text_hash", "set_key", "size", "sketch", "heads"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text), _text_hash(text))
    shape = "doc_id bigint, text_hash bigint, set_key binary, size bigint, sketch binary, heads array<bigint>"
    return rows.mapInArrow(run, shape)


def _text_hash(text: str):  # noqa: ANN202
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")


def matrix(column: pa.Array, kind: type = np.uint16) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, TOKENS)


def with_short_sketch(sets: DataFrame) -> DataFrame:
    """Adds ``short``, the low bytes of the sketch: enough to compare, not to split by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [x.tobytes() for x in matrix(batch.column("sketch")).astype(np.uint8)]
            names = [*batch.schema.names, "short"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.binary())], names)

    return sets.mapInArrow(run, T.StructType([*sets.schema.fields, T.StructField("short", T.BinaryType())]))


# --- the tree of chosen paths ------------------------------------------------------


class Choices(dict):
    """Node → the tokens by which it splits: each with chance 1 / (similarity · TOKENS)."""

    def __init__(self, similarity: float):
        self.bound = np.uint64(int(2**64 / (similarity * TOKENS)))

    def __missing__(self, node: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            drawn = mixed(np.uint64(node % 2**64) + MIX * np.arange(1, TOKENS + 1, dtype=np.uint64))
        self[node] = found = np.flatnonzero(drawn < self.bound)
        return found


def child(node: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mixed(node.astype(np.uint64) * MIX + token.astype(np.uint64) + np.uint64(1))
        return mixed(x ^ (value.astype(np.uint64) << np.uint64(17))).astype(np.int64)


def _split(nodes: np.ndarray, values: np.ndarray, choices: Choices) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for all tokens that the rows' nodes split by."""
    distinct, inverse = np.unique(nodes, return_inverse=True)
    chosen = [choices[int(n)] for n in distinct]
    sizes = np.array([len(c) for c in chosen])
    flat = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    per_row = sizes[inverse]
    rows = np.repeat(np.arange(len(nodes)), per_row)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    tokens = flat[starts[inverse[rows]] + within].astype(np.int64)
    return rows, child(nodes[rows], tokens, values[rows, tokens])


def roots(seed: int, runs: range, choices: Choices) -> np.ndarray:
    """A node for each run; one that would split by no token is drawn anew."""
    found = []
    for run in runs:
        node, again = 0, 0
        while not again or not len(choices[node]):
            with np.errstate(over="ignore"):
                node = int(mixed(np.uint64(seed) * MIX + np.uint64(run + 1) + (np.uint64(again) << np.uint64(32))).astype(np.int64))
            again += 1
        found.append(node)
    return np.array(found, np.int64)


def first_runs(seed: int, choices: Choices, similarity: float, recall: float) -> range:
    """Runs of the first pass: RUNS, and more until nodes of the first level alone keep the recall.

    Pairs in no large node are looked for there only, so those runs have to suffice.
    """
    runs = range(RUNS)
    while missed(roots(seed, runs, choices), choices, similarity, 1) > 1 - recall:
        runs = range(runs.stop + 1)
    return runs


def first_level(sets: DataFrame, runs: range, seed: int, similarity: float) -> DataFrame:
    """(node, id, label): the children of the runs' roots, by the sketches' 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices = Choices(similarity)
        tops = roots(seed, runs, choices)
        for batch in batches:
            values, ids, labels = matrix(batch.column(2)), batch.column(0), batch.column(1)
            for top in tops:
                rows, nodes = _split(np.full(len(values), top), values, choices)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), ids.take(at), labels.take(at)], ["node", "id", "label"])

    return sets.select("id", "label", "sketch").mapInArrow(run, "node bigint, id bigint, label bigint")


def next_level(large: DataFrame, similarity: float, least: int) -> DataFrame:
    """Children of large nodes, and links (node null) of their sets to each node's pivot.

    A set that resembles the pivot takes its label, so that nodes of one component
    only are not split on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices = Choices(similarity)
        for batch in batches:
            nodes, ids, labels, pivots = (batch.column(c).to_numpy() for c in ("node", "id", "label", "pivot"))
            values = matrix(batch.column("sketch"))
            near = (values == matrix(batch.column("pivot_sketch"))).sum(1) >= least
            link = near & (ids != pivots)
            labels = np.where(near, batch.column("pivot_label").to_numpy(), labels)
            rows, children = _split(nodes, values, choices)
            out = {
                "node": pa.array(np.r_[np.zeros(link.sum(), np.int64), children], mask=np.r_[np.ones(link.sum(), bool), np.zeros(len(rows), bool)]),
                "id": pa.array(np.r_[ids[link], ids[rows]]),
                "label": pa.array(np.r_[pivots[link], labels[rows]]),
            }
            yield pa.RecordBatch.from_pydict(out)

    return large.mapInArrow(run, "node bigint, id bigint, label bigint")


def linked(nodes: np.ndarray, values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the same node whose sketches agree, or agree with others that do: (row, first such row)."""
    n = len(nodes)
    label = np.arange(n)
    for d in range(1, n):
        i = np.flatnonzero(nodes[:-d] == nodes[d:])
        if not len(i):
            break
        i = i[(label[i] != label[i + d])]
        i = i[(values[i] == values[i + d]).sum(1) >= least]
        if len(i):
            a, b = label[i], label[i + d]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    # Stars, not chains: their components are found in fewer rounds.
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


def brute_force(rows: DataFrame, least: int) -> DataFrame:
    """(a, b) links of small nodes; ``rows`` are (node, id, short)."""

    def compare(nodes: np.ndarray, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        i, j = linked(nodes, values, least)
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), np.uint8))
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            # The last node may go on in the next batch.
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut >= 2048:
                yield compare(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None and len(held[0]):
            yield compare(*held)

    ordered = rows.select("node", "id", "short").repartition("node").sortWithinPartitions("node", "id")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Nodes that stayed large, as nodes of two blocks each: all pairs still meet."""
    blocks = F.greatest(F.ceil(F.col("n") / SMALL), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks)
    others = F.sequence(F.lit(0), blocks - 1)
    pair = F.explode(F.transform(others, lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"))))
    return rows.withColumn("pair", pair).withColumn("node", F.xxhash64("node", "pair.i", "pair.j")).drop("pair")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id of each connected component, by alternating stars.

    Ends that very many links share are joined apart: see ``hot_join``.
    """
    edges = stored(_ordered(links).distinct(), "links")
    before, now = None, _state(edges)
    while now != before:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # Larger neighbours hang on the least of all, then smaller ones on theirs.
        large = hot_join(both, least, "u", 2 * now[0]).filter(F.col("v") > F.col("u"))
        down = large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter(F.col("u") != F.col("v"))
        down = stored(down, "links")
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = hot_join(down, low, "u", now[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        following = stored(_ordered(small).distinct(), "links")
        discard(edges, down)
        edges, before, now = following, now, _state(following)
    tops = edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()
    return edges.select(F.col("b").alias("id"), F.col("a").alias("label")).union(tops)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _ordered(links: DataFrame) -> DataFrame:
    pair = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair.filter(F.col("a") != F.col("b"))


def survival(levels: int) -> float:
    """Chance that a pair at the threshold, together in a node, still is so some levels below."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return p


def missed(tops: np.ndarray, choices: Choices, similarity: float, depth: int) -> float:
    """Chance that runs from these roots, down to a level, miss a pair at the threshold.

    The pair shares each of the tokens that the roots really drew with chance
    ``similarity``; a token that several roots drew is counted once.
    """
    tokens = {int(t) for top in tops for t in choices[int(top)]}
    return (1 - similarity * survival(depth - 1)) ** len(tokens)


def candidates(sets: DataFrame, similarity: float, recall: float, seed: int) -> DataFrame:
    """(id, label): components of what the sketches link, over all runs.

    ``sets`` are (id, sketch, short, heads). The sketch threshold lies four standard
    errors below the similarity. The first pass has so many runs that pairs in small
    nodes are missed with a chance of at most 1 - recall, whatever the seed and the
    similarity. Sets of large nodes, which go on to lower levels, go into further passes
    until the same holds for them.
    """
    least = math.ceil(TOKENS * similarity - 4 * math.sqrt(TOKENS * similarity * (1 - similarity)))
    choices = Choices(similarity)
    found: list[DataFrame] = []
    tables: list[DataFrame] = []
    runs, rest, known = first_runs(seed, choices, similarity, recall), 1.0, sets
    rows = stored(sets.select(F.explode("heads").alias("node"), "id", F.col("id").alias("label")), "paths")
    while True:
        links, depth, hot = _pass(known, rows, similarity, least, tables)
        rest *= missed(roots(seed, runs, choices), choices, similarity, depth)
        found += links
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        labels = stored(components(every), "components")
        if rest <= 1 - recall or hot is None:
            discard(*tables)
            return labels
        runs = range(runs.stop, runs.stop + RUNS)  # with the sets of large nodes
        known = sets.join(hot, "id", "left_semi")
        labelled = known.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        rows = stored(first_level(labelled, runs, seed, similarity), "paths")
        discard(labels)


def _pass(
    sets: DataFrame, rows: DataFrame, similarity: float, least: int, tables: list[DataFrame]
) -> tuple[list[DataFrame], int, DataFrame | None]:
    """The links below the nodes of ``rows``, the deepest level, and the first large nodes' sets, if any.

    ``rows`` (node, id, label) are a stored table. ``tables`` gets those that links lie in.
    """
    links: list[DataFrame] = []
    hot = None
    tables.append(rows)
    for level in range(1, LEVELS + 1):
        # A node of one label can link nothing new; that holds for single sets, too.
        nodes = rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("id").alias("pivot")
        )
        nodes = stored(nodes.filter(F.col("low") < F.col("high")).select("node", "n", "pivot"), "nodes")
        is_large, total, last = nodes.filter(F.col("n") > SMALL), rows.count(), level == LEVELS
        more = not last and not is_large.isEmpty()
        if more:
            # Rows of large nodes are not shuffled to their node: few keys, by their bound.
            very = F.broadcast(is_large.filter(F.col("n") > total // HOT_KEYS).select("node"))
            small = rows.join(very, "node", "left_anti").join(nodes.filter(F.col("n") <= SMALL), "node")
        else:
            small = in_blocks(hot_join(rows, nodes, "node", total)) if last else rows.join(nodes, "node")
        links.append(stored(brute_force(small.join(sets.select("id", "short"), "id"), least), "links"))
        tables.append(links[-1])
        if hot is None and more:
            hot = stored(hot_join(rows, is_large, "node", total, least=SMALL).select("id").distinct(), "hot")
            # Levels below read the sketches of the large nodes' sets only.
            sets = stored(sets.select("id", "sketch", "short").join(hot, "id"), "hot-sets")
            tables += [hot, sets]
        if not more:
            discard(nodes)
            return links, level, hot
        sketches = sets.select("id", "sketch")
        pivots = is_large.join(rows.withColumnsRenamed({"id": "pivot", "label": "pivot_label"}), ["node", "pivot"])
        pivots = pivots.dropDuplicates(["node"]).join(sketches.withColumnsRenamed({"id": "pivot", "sketch": "pivot_sketch"}), "pivot")
        large = hot_join(rows, pivots, "node", total, least=SMALL).join(sketches, "id")
        following = stored(next_level(large, similarity, least), "paths")
        discard(nodes)
        tables.append(following)
        links.append(following.filter(F.col("node").isNull()).select(F.col("id").alias("a"), F.col("label").alias("b")))
        rows = following.filter(F.col("node").isNotNull())
    raise AssertionError("the last level returns")


# --- exact verification ------------------------------------------------------------


def exact(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs of sets whose Jaccard similarity is high enough."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    shared = counts[inverse] > 1
    number = np.cumsum(counts > 1) - 1
    rows, columns = rows[shared], number[inverse[shared]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    both = np.zeros((n, n), np.float32)
    width = 4096
    for low in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        a, b = np.searchsorted(columns, [low, low + width])
        m = np.zeros((n, width), np.float32)
        m[rows[a:b], columns[a:b] - low] = 1
        both += m @ m.T
    total = sizes[:, None] + sizes[None, :]
    return (both.astype(np.float64) * (1 + similarity) >= similarity * total - 1e-6) & ~np.eye(n, dtype=bool)


def least_reachable(near: np.ndarray) -> np.ndarray:
    """The first row that each row is connected to."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(rows: DataFrame, similarity: float) -> DataFrame:
    """(id, root, links, alone) of each set's part in a task.

    ``rows`` are (task, cross, side, id, copies, shingles, alone) of tasks of one
    block or of two; in a task of two, pairs across them count only. A task's sets are
    held at once: two blocks of at most BLOCK sets and about BLOCK_SHINGLES shingles,
    or one longer set each.
    """

    def settle(task: list[tuple]) -> list[tuple]:
        _, cross, sides, ids, copies, found, alone = zip(*task)
        if len(task) < 2:
            return [(ids[0], ids[0], 0, alone[0])]
        near = exact([np.frombuffer(x, np.uint64) for x in found], similarity)
        if cross[0]:
            side = np.array(sides)
            near &= side[:, None] != side[None, :]
        links = near @ np.array(copies, np.int64)
        root = least_reachable(near)
        return [(i, ids[k], int(x), one) for i, k, x, one in zip(ids, root, links, alone)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = tuple(batch.column(c)[i].as_py() for c in _TASK)
                if held and held[0][0] != row[0]:
                    out += settle(held)
                    held = []
                held.append(row)
            yield _settled(out)
        if held:
            yield _settled(settle(held))

    ordered = rows.repartition("task").sortWithinPartitions("task", "id")
    return ordered.mapInArrow(run, "id bigint, root bigint, links bigint, alone boolean")


_TASK = ("task", "cross", "side", "id", "copies", "shingles", "alone")


def _settled(out: list[tuple]) -> pa.RecordBatch:
    names, kinds = ["id", "root", "links", "alone"], [pa.int64()] * 3 + [pa.bool_()]
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


#: Members up to which a filter with PLACES places for each is broadcast: 8 MB at most;
#: a member marks MARKS of them. Beyond, texts meet the members' ids in a shuffle.
FILTERED, PLACES, MARKS = 1 << 22, 16, 3


def with_shingles(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """``members`` (set_key, rep, …) with their shingles, from the text of row ``rep``.

    Texts of rows that are no member go nowhere; what is shuffled of the others are
    their shingles, and beyond FILTERED members their texts.
    """
    rows = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    n = members.count()
    if n <= FILTERED:
        rows = _filtered(rows, members, max(n * PLACES, 1 << 15))
    else:
        ids = members.select(F.col("rep").alias("_rep")).distinct()
        rows = rows.join(ids.hint("merge"), F.col("rep").eqNullSafe(F.col("_rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(raw) for raw in raw_texts(batch.column(1))]
            columns = [batch.column(0), pa.array([set_key(f) for f in found], pa.binary())]
            columns.append(pa.array([f.tobytes() for f in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["_rep", "_key", "shingles"])

    # Another text may have the row's id: only the set of the key counts.
    found = rows.mapInArrow(run, "_rep bigint, _key binary, shingles binary")
    same = (F.col("set_key") == F.col("_key")) & F.col("rep").eqNullSafe(F.col("_rep"))
    return members.join(found, same).drop("_rep", "_key", "rep").dropDuplicates(["id"])


def _filtered(rows: DataFrame, members: DataFrame, places: int) -> DataFrame:
    """Rows whose id is that of a member, and a few others, by a bitmap of hashed ids."""

    def marks(key: str):  # noqa: ANN202
        known = F.coalesce(F.col(key), F.lit(-1).cast("long"))
        return F.array(*(F.pmod(F.xxhash64(known, F.lit(i)), F.lit(places)) + 1 for i in range(MARKS)))

    bitmaps = (
        members.select(F.explode(marks("rep")).alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    )
    # A bit for each place: FILTERED * PLACES bits at most. Places, and bitmaps of 32,768
    # of them, count from 1.
    size = 1 << 15
    whole = np.zeros((places // size + 2) * size // 8, np.uint8)
    for r in bitmaps.collect():
        at = (r["bucket"] - 1) * size // 8
        whole[at : at + size // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).flatten().to_numpy().reshape(-1, MARKS) - 1
            kept = ((shared.value[at // 8] >> (at % 8).astype(np.uint8)) & 1).all(1)
            yield batch.select([0, 1]).filter(pa.array(kept))

    return rows.select("rep", "text", marks("rep").alias("marks")).mapInArrow(run, "rep bigint, text string")


def in_bands(members: DataFrame, similarity: float) -> DataFrame:
    """``members`` (label, id, size, …) with their ``tasks`` of ``verify``, and ``alone``.

    Sets that differ more in size than the similarity allows are never in one task: a
    component is cut into bands of sizes, of which only neighbours can hold a pair, and
    bands into blocks.
    """
    total = members.count()
    # Wider than 1 / similarity by more than logarithms are wrong: neighbours suffice.
    width = -math.log(similarity) * (1 + 1e-9)
    members = members.withColumn("band", F.floor(F.log("size") / width).cast("int"))
    members = members.withColumn("key", F.struct("label", "band"))
    bands = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("_all"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("_all") / BLOCK_SHINGLES)).cast("int")
    bands = bands.select("key", "n", blocks.alias("blocks"))
    near = bands.select(F.col("key.label").alias("label"), F.col("key.band").alias("band"), "n", "blocks")
    for name, step in (("below", -1), ("above", 1)):
        other = bands.select(F.col("key.label").alias("label"), (F.col("key.band") - step).alias("band"), F.col("blocks").alias(name))
        near = near.join(other, ["label", "band"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    near = near.withColumn("key", F.struct("label", "band")).drop("label", "band")
    placed = hot_join(members, near, "key", total).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def span(n: str):  # noqa: ANN202
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    # (band of the lower block, lower block, upper block, whether they are apart, side)
    own = F.transform(
        span("blocks"),
        lambda o: _task(F.col("band"), F.least("side", o), F.greatest("side", o), F.lit(0), o != F.col("side"), F.col("side")),
    )
    # Across bands, sides are the bands.
    up = F.transform(span("above"), lambda o: _task(F.col("band"), F.col("side"), o, F.lit(1), F.lit(True), F.lit(0)))
    down = F.transform(span("below"), lambda o: _task(F.col("band") - 1, o, F.col("side"), F.lit(1), F.lit(True), F.lit(1)))
    alone = (F.col("blocks") == 1) & (F.col("above") == 0) & (F.col("below") == 0)
    return placed.select("label", "id", "set_key", "rep", "copies", F.concat(own, up, down).alias("tasks"), alone.alias("alone"))


def _task(band, low, high, apart, cross, side):  # noqa: ANN001, ANN202
    return F.struct(
        band.cast("int").alias("band"), low.alias("low"), high.alias("high"), apart.alias("apart"), cross.alias("cross"), side.alias("side")
    )


def jaccard_join(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = 0.8,
    recall: float = 0.99,
    seed: int = 11,
) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of ``docs``.

    Texts are sets of word shingles, words split at ASCII white space; a text of fewer
    words than a shingle is one shingle. ``n_links`` is the number of other rows whose
    set has at least the similarity, ``class_id`` the least id that a row is connected
    to by links. A text that is null or has no words links to nothing: its class is
    its own id. Rows of equal texts, repeated rows among them, are linked copies. Null
    ids are larger than all others, and stay null where they are a class's least.
    """
    rows, known = _known(docs, key, text, similarity, recall, seed)
    done = hot_join(rows.select("doc_id", "set_key"), known, "set_key", rows.count(), "left")
    return done.select(
        "doc_id",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def distinct_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = 0.8,
    recall: float = 0.99,
    seed: int = 11,
) -> DataFrame:
    """One row of ``docs`` of each class of ``jaccard_join``, all columns.

    It is the one with the least id, null last; of several texts with that id, the one
    with the least set, then the least hash, on every run. Texts without words are
    classes of their own: all their rows stay.
    """
    rows, known = _known(docs, key, text, similarity, recall, seed)
    first = known.filter("stays").select("set_key", F.col("rep").alias("_rep"))
    lone = rows.filter(F.col("set_key").isNull()).select("doc_id", "text_hash").distinct()
    # Rows of one id and set, of which only blanks can differ: few, whatever the class.
    own = rows.join(first, "set_key").filter(F.col("doc_id").eqNullSafe(F.col("_rep")))
    own = own.groupBy("set_key", "doc_id").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")

    def name(doc, hashed):  # noqa: ANN001, ANN202
        return F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("null")), hashed.cast("string"))

    named = docs.withColumn("_name", name(F.col(key).cast("long"), _text_hash(text)))
    kept = stored(own.select(name(F.col("doc_id"), F.col("text_hash")).alias("_name")), "kept")
    lone = lone.select(name(F.col("doc_id"), F.col("text_hash")).alias("_name"))
    # Repeated rows of a document that stays are one.
    one = named.join(kept.hint("merge"), "_name", "left_semi").dropDuplicates(["_name"])
    empty = F.length(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))) == 0
    return one.unionByName(named.filter(empty).join(lone, "_name", "left_semi")).drop("_name")


def _known(docs: DataFrame, key: str, text: str, similarity: float, recall: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their set, and sets with class, links and whether the class's document has it."""
    rows = stored(sketches(docs, key, text, similarity, seed, recall), "sketches")
    classes = (
        rows.filter(F.col("set_key").isNotNull())
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.min("sketch").alias("sketch"), F.first("heads").alias("heads"))
        # Stored below: a number that no other set has, whatever the keys' hashes.
        .withColumn("id", F.monotonically_increasing_id())
    )
    classes = stored(with_short_sketch(classes), "classes")
    labels = candidates(classes.select("id", "sketch", "short", "heads"), similarity, recall, seed)
    members = labels.join(classes.select("id", "set_key", "rep", "copies", "size"), "id")
    members = stored(in_bands(stored(members, "members"), similarity), "bands")
    tasks = with_shingles(docs, members, key, text).withColumn("t", F.explode("tasks"))
    # The task's whole name: a hash of it might be another's, too.
    task = F.concat_ws(":", "label", "t.band", "t.low", "t.high", "t.apart").alias("task")
    tasks = tasks.select(task, "t.cross", "t.side", "id", "copies", "shingles", "alone")
    return rows, stored(_classed(classes, stored(verify(tasks, similarity), "verified")), "known")


def _classed(classes: DataFrame, verified: DataFrame) -> DataFrame:
    """(set_key, rep, class_id, n_links, stays, n) of all sets; ``n`` are their rows."""
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    # Components inside one task are whole; others are joined over their tasks.
    apart = verified.filter(~F.col("alone")).select(F.col("id").alias("a"), F.col("root").alias("b"))
    whole = verified.filter("alone").select("id", F.col("root").alias("label")).distinct()
    labels = whole if apart.isEmpty() else whole.union(components(apart))
    found = classes.select("id", "set_key", "rep", "copies").join(links, "id", "left").join(labels, "id", "left")
    found = found.withColumn("label", F.coalesce("label", "id"))
    first = F.struct(F.col("rep").isNull().alias("none"), "rep", "set_key")
    least = found.groupBy("label").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    return hot_join(found, least, "label", classes.count()).select(
        "set_key",
        "rep",
        F.col("first.rep").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        (F.col("set_key") == F.col("first.set_key")).alias("stays"),
        F.col("copies").alias("n"),
    )
