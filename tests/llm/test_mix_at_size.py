"""Many sources, permutations, nested splits and the mixed texts."""

import collections
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.text(max_size=5))
def test_permutations_are_one_to_one(n, key):
    assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_neighbours_are_scattered():
    n = 100_000
    steps = np.diff(mixing.permuted(np.arange(n), n, "k"))
    assert len(np.unique(steps)) > 0.6 * n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.integers(1, 7), st.randoms())
def test_cells_split_quotas_exactly(quota, n, random):
    quota = np.array(quota, np.int64)
    cuts = sorted(random.randint(0, int(quota.sum())) for _ in range(n - 1))
    counts = np.diff([0, *cuts, int(quota.sum())])
    spans = collections.defaultdict(list)
    for k, index, first, held in mixing.cells(quota, counts, 3, 5):
        assert held.sum() == counts[k]
        for i, a, m in zip(index, first, held):
            spans[int(i)].append((a, a + m))
    for i, q in enumerate(quota):
        runs = sorted(spans[i])
        assert [a for a, _ in runs] == [0, *(b for _, b in runs)][: len(runs)] and (not q or runs[-1][1] == q)


def test_shares_of_very_large_nodes():
    held = np.array([10**11, 5, 3 * 10**10, 0, 10**9], np.int64)
    random = np.random.default_rng(1)
    for total in (0, 7, 10**10, int(held.sum()) - 3, int(held.sum())):
        out = mixing.drawn(random, held, total)
        assert out.sum() == total and (out >= 0).all() and (out <= held).all()
    half = mixing.drawn(random, held, int(held.sum()) // 2)
    assert abs(half[0] / held[0] - 0.5) < 1e-4


def filled(sizes, weights, share, limit):
    total, full = share * sum(sizes.values()), set()
    while True:
        rest, open_weight = total - sum(limit * sizes[s] for s in full), sum(weights[s] for s in sizes if s not in full)
        wanted = {s: limit * sizes[s] if s in full else rest * weights[s] / open_weight for s in sizes}
        more = {s for s in sizes if s not in full and wanted[s] > limit * sizes[s]}
        if not more:
            return wanted
        full |= more


@pytest.mark.parametrize("groups", [4096, 3])
def test_many_sources_are_taken_to_the_word(spark, monkeypatch, groups):
    """More sources than groups, so that some share one; brute force of targets and of takes."""
    monkeypatch.setattr(mixing, "GROUPS", groups)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 16)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 8)
    random = np.random.default_rng(3)
    made = [(i, " ".join(f"w{i}_{k}" for k in range(int(random.integers(0, 60)))), f"s{int(random.integers(0, 40)):02d}") for i in range(400)]
    made += [(400, "a b c", None), (400, "a b c", None), (None, "d e", "s01"), (401, None, "s01")]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    documents, segments = mixing.mix(docs)
    out = mixing.taken(documents, segments).toPandas()
    sizes = collections.Counter()
    for _, t, s in made:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    wanted = filled(dict(sizes), dict(zip(names, itertools.cycle([3.0, 1.0, 2.0]))), 1.5, 2.0)
    for s, rows in out.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert abs(rows.target.iloc[0] - wanted[s]) < 1e-6 and rows.taken.sum() == round(wanted[s]) and rows["size"].sum() == sizes[s]
    assert (out.taken <= 2 * out["size"]).all() and len(out) == len(made)
    # Each word is taken once an epoch at most, and a shard's slots are its own.
    spans = collections.defaultdict(list)
    slots = collections.defaultdict(set)
    for r in segments.collect():
        spans[r["name"], r["part"], r["place"], r["epoch"]].append((r["first"], r["end"]))
        slots[r["shard"], r["slot"]].add((r["name"], r["epoch"]))
    for runs in spans.values():
        runs.sort()
        assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:]))
    assert all(len(x) == 1 for x in slots.values()) and len({s for s, _ in slots}) > 5


def test_mixed_texts_are_the_taken_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 4)
    made = [(i, "  ".join(f"w{i}_{k}" for k in range(i % 9)), "ab"[i % 2]) for i in range(40)] + [(7, " x\ty ", "a"), (7, " x\ty ", "a"), (None, None, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").withColumn("name", F.lit("clash"))
    documents, segments = mixing.mix(docs)
    out = mixing.mixed_texts(docs, documents, segments).collect()
    assert len(out) == len(made)
    for r in out:
        words = [w for p in r["pieces"] for w in p["text"].split()]
        assert len(words) == r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None and r["doc_id"] != 7:
            assert set(words) <= set(made[r["doc_id"]][1].split())
    assert mixing.mixed_texts(docs.limit(0), *mixing.mix(docs.limit(0))).count() == 0
