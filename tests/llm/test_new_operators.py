"""Line dedup, conversation repair and hard negatives against brute force, and on edge cases."""

import collections
import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import lines, negatives, repair

# Line dedup


def keys_of(text):
    return [x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(lines.UPPER, lines.LOWER)) for x in (text or "").split("\n")]


def dedup(docs):
    """Contract: keys of 20 code points in 3 documents stay in the largest id only."""
    held = collections.defaultdict(set)
    for i, t in docs:
        for k in keys_of(t):
            held[k].add(i)
    out = []
    for i, t in docs:
        kept = [x for x, k in zip((t or "").split("\n"), keys_of(t), strict=True) if len(k) < 20 or len(held[k]) < 3 or i == max(held[k])]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    return sorted(out)


LINES = ["A line of thirty letters or so", "a line of Thirty letters or so \t", "another line that is long enough", "short", "", "exactly twenty chars", "é" * 20, "é" * 19]


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, None if i % 17 == 0 else "\n".join(rng.choice(LINES, rng.integers(0, 6))) if i % 3 else f"only here, in text number {i:09d}\n{LINES[0]}") for i in range(n)]


def told(index, df):
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"] or "") for r in index.deduplicated(df).collect())


def test_lines_come_and_go(spark):
    """Loads, a load that repeats documents, deletions: always what the documents that are there tell."""
    docs = corpus(60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = lines.LineIndex(spark, shards=3)
    index.insert(df.filter("doc_id < 20"))
    assert told(index, df.filter("doc_id < 20")) == dedup(docs[:20])
    index.insert(df.filter("doc_id >= 10"))
    assert told(index, df) == dedup(docs)
    index.delete(df.filter("doc_id % 5 < 3 OR doc_id > 50").select("doc_id"))
    rest = [d for d in docs if not (d[0] % 5 < 3 or d[0] > 50)]
    assert told(index, df.filter("doc_id % 5 >= 3 AND doc_id <= 50")) == dedup(rest)
    # Reversible: the state equals that of an index that never saw the deleted documents.
    fresh = lines.LineIndex(spark, shards=3).insert(spark.createDataFrame(rest, "doc_id long, text string"))
    for a, b in ((index.totals(), fresh.totals()), (index.alive(), fresh.alive())):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)

    def fingerprints(i):
        return {r["shard"]: len(lines.Cuckoo.read([x.asDict() for x in r["tables"]])) for r in i.filters.collect()}

    assert {k: v for k, v in fingerprints(index).items() if v} == fingerprints(fresh)
    known = {(r["h1"], r["h2"]): r["known"] for r in index.known(index.references(df)).collect()}
    assert all(known[r["h1"], r["h2"]] for r in fresh.totals().collect())
    index.insert(df)
    assert told(index, df) == dedup(docs)


def test_lines_edges(spark):
    shape = "doc_id long, text string, n_lines string, h1 string, doc string"
    long = "\n".join(f"a common line, number {i:07d}" for i in range(20_000))
    made = [(1, long, "x", "x", "x"), (2, long, None, None, None), (None, long, "x", "x", "x"), (3, None, "", "", ""), (None, "", "", "", ""), (2, LINES[0], "", "", "")]
    df = spark.createDataFrame(made, shape)
    got = lines.LineIndex(spark).insert(df).deduplicated(df)
    assert got.columns == ["doc_id", "text", "h1", "doc", "n_lines", "n_dropped", "kept_text"]
    rows = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"]) for r in got.collect())
    # The text without an id is a document, too: the lines stand in three and stay in the largest id.
    assert rows == [(0, 1, 0), (0, 20_000, 20_000), (1, 20_000, 20_000), (2, 1, 0), (2, 20_000, 0), (3, 1, 0)]
    assert lines.LineIndex(spark).insert(df.limit(0)).deduplicated(df.limit(0)).isEmpty()


@pytest.mark.parametrize("n", [1, 100, 5000])
def test_cuckoo(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, n))
    h1[: n // 10], h2[: n // 10] = h1[0], h2[0]  # more equal fingerprints than two buckets hold
    f = lines.Cuckoo()
    for part in np.array_split(np.arange(n), 4):
        f.insert(h1[part], h2[part])
    assert len(f) == n and f.contains(h1, h2).all()
    strange = rng.integers(-(2**62), 2**62, (2, 20_000))
    assert f.contains(*strange).mean() < 0.002
    f = lines.Cuckoo.read(f.written())
    f.delete(h1[n // 2 :], h2[n // 2 :])
    assert len(f) == n // 2 and f.contains(h1[: n // 2], h2[: n // 2]).all()
    f.delete(h1[: n // 2], h2[: n // 2])
    assert len(f) == 0


# Conversation repair


def cheapest(turns):
    """Uniform-cost search over whole strings of initials: (cost, audit, roles and texts)."""
    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(turns) and state in (0, 3):
            return cost, audit, out
        if (cost, audit, at, state) in seen or len(audit) > 3 * len(turns) + 4:
            continue
        seen.add((cost, audit, at, state))
        options = [(2, "I", at, state, (role, "")) for role in ("user", "assistant")]
        if at < len(turns):
            role, text, fault = turns[at]
            options.append((3, "D", at + 1, state, None))
            if fault not in ("blank", "duplicate"):
                ragged = int(fault == "truncated")
                options.append((ragged, "K", at + 1, state, (role, text)))
                options += [(2 + ragged, "R", at + 1, state, (r, text)) for r in ("user", "assistant")]
        for c, e, next_at, s, said in options:
            s = s if said is None else to.get((s, said[0][:1]))
            if s is not None:
                heapq.heappush(heap, (cost + c, audit + e, next_at, s, out + (said,) * (said is not None)))
    raise AssertionError


def expected(rows):
    """The contract for one conversation, after damage: rows of (turn, role, text)."""
    seen, turns, counts = set(), [], collections.Counter()
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "fine"
        seen.add((role, text))
        counts[fault] += 1
        turns.append((role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, out = cheapest(turns)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        found = out[conv]
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            found += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0)) for c, v in out.items()}


def test_repair_against_search(spark):
    rng = np.random.default_rng(5)
    roles, said = ["user", "assistant", "system", None, "tool", "", "up"], ["Yes.", "no", "", " \t", "What?", None, "Yes.\n "]
    rows = []
    for conv in [*range(150), None]:
        n = int(rng.integers(0, 7)) + 1
        rows += [(conv, None if t == 0 and n == 3 else t * (1 + n % 2), roles[rng.choice(7, p=[0.35, 0.35, 0.1, 0.05, 0.05, 0.05, 0.05])], said[rng.choice(7)]) for t in range(n)]
    df = spark.createDataFrame([r + ("x", True) for r in rows], "conv_id long, turn long, role string, text string, fault string, gone boolean")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damage(df)).collect()}
    want = damaged(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert got[conv] == expected(turns), (conv, turns)


def test_repair_edges(spark):
    shape = "conv_id long, turn long, role string, text string, gone boolean"
    empty = hashlib.sha256(b"").hexdigest()
    assert repair.repair(spark.createDataFrame([], shape)).isEmpty()
    made = [(1, 0, "user", "x.", True), (2, 5, "user", "a.", False), (2, 5, "user", "a.", False), (2, 5, "user", "a.", False), (3, None, None, None, False)]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(spark.createDataFrame(made, shape)).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[2][:7] == (0, 0, 2, 0, 2, 8, "KDDI") and got[3] == (0, 1, 0, 0, 0, 3, "D", empty)
    # One conversation of very many turns is read a turn at a time.
    n = 200_000
    long = spark.range(n).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(False).alias("gone"))
    r = repair.repair(long).first()
    assert (r["cost"], r["audit"]) == (0, "K" * n)


# Hard negatives


def mined(rows, every=50):
    """All pairs: rows of (vec_id, label, vector)."""
    kept = [(i, lab, np.floor(256 * np.array(v, float)).astype(object)) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept = [r for r in kept if (r[2] * r[2]).sum() < 2**62]  # scores that a long holds
    big, out = 1 << 63, []
    for a, (i, lab, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = [(int((v * w).sum()), j, m) for b, (j, m, w) in enumerate(kept) if b != a and len(w) == len(v)]
        order = sorted(scores, key=lambda s: (-s[0], big if s[1] is None else s[1]))
        for ps, p, _ in [s for s in order if s[2] == lab][:5]:
            found = [s for s in order if s[2] != lab and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(i, p, r + 1, n, ps, ns) for r, (ns, n, _) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_against_all_pairs(spark, monkeypatch, seed):
    """Vectors of all norms, ties, copies, nulls, two lengths; few components a chunk, small blocks."""
    monkeypatch.setattr(negatives, "BLOCK", 32)
    monkeypatch.setattr(negatives, "TILE", 7)
    monkeypatch.setattr(negatives, "BUCKET", 40)
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), (rng.normal(size=6) * 2.0 ** rng.integers(-8, 3 + 12 * seed)).tolist()) for i in range(300)]
    rows += [(1000 + i, 1, [0.5] * 6) for i in range(60)] + [(2000 + i, 2, [0.25] * 6) for i in range(60)] + [(50, 1, [0.5] * 6)] * 2
    rows += [(3000 + i, i % 3, [float(i), 1.0]) for i in range(9)] + [(None, 2, [0.5] * 6), (4000, 0, []), (4050, 1, [])]
    rows += [(5000, None, [0.5] * 6), (5050, 1, None), (5100, 1, [None] * 6), (5150, 1, [float("nan")] * 6), (5200, 1, [float("inf")] * 6), (5250, 1, [0.0] * 6)]
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, label int, embedding array<double>, norm string")
    for chunk in (24, 1 << 20):
        got = negatives.hard_negatives(df, anchors=F.col("vec_id") % 50 == 0, chunk=chunk)
        assert sorted(map(tuple, got.collect()), key=repr) == mined(rows)
    assert negatives.hard_negatives(df.limit(0)).isEmpty()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u", "a", "s", "x", ""]), st.sampled_from(["fine", "truncated", "blank", "duplicate"])), max_size=6))
def test_composition(turns):
    """Policies, followed from the start, are the cheapest edits."""
    machine, costs, policies = repair.Backward(), tuple(repair.END), []
    for initial, fault in reversed(turns):
        costs, policy = machine.step(costs, initial, fault)
        policies.append(policy)
    now = repair._Forward(1)
    for k, ((initial, fault), policy) in enumerate(zip(turns, reversed(policies), strict=True)):
        now.read(k, initial, "t", initial, fault, policy)
    cost, audit, _ = cheapest([(i, "t", f) for i, f in turns])
    assert now.end()[6:8] == (cost, audit)
