"""The Jaccard join where nodes are split, where members are many, and its lone sets."""

import numpy as np

from fieldloom.llm import jaccard

SHAPE = "doc_id long, text string"


def test_recall_at_the_threshold_in_large_nodes(spark, monkeypatch):
    """Pairs of similarity 0.80 to 0.82 among documents that share most of a text."""
    monkeypatch.setattr(jaccard, "SMALL", 1024)
    random = np.random.default_rng(2)
    base = [f"b{i}" for i in range(300)]

    def replaced(words, at, n, tag):
        return words[:at] + [f"{tag}_{k}" for k in range(n)] + words[at + n :]

    rows, n, pairs = [], 2200, 220
    for i in range(n):
        at = int(random.integers(0, 110))
        own = replaced(base, at, 66, f"x{i}")
        rows.append((i, " ".join(own)))
        if i < pairs:
            twin = replaced(own, int(random.integers(at + 75, 268)), 27, f"y{i}")
            rows.append((n + i, " ".join(twin)))
    docs = spark.createDataFrame(rows, SHAPE)
    text = dict(rows)
    sets = {i: set(zip(*(text[i].split()[k:] for k in range(5)))) for i in text}
    for i in range(pairs):
        assert 0.8 <= len(sets[i] & sets[n + i]) / len(sets[i] | sets[n + i]) <= 0.82
    # The largest node below some root holds more sets than are compared by brute force.
    heads = jaccard.sketches(docs, "doc_id", "text", 0.8, 11).selectExpr("explode(heads) AS node")
    assert heads.groupBy("node").count().agg({"count": "max"}).first()[0] > jaccard.SMALL
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(docs).collect()}
    found = sum(got[n + i] == (i, 1) and got[i] == (i, 1) for i in range(pairs))
    assert found >= 0.9 * pairs
    assert all(got[i] == (i, 0) for i in range(pairs, n))


def test_many_members_meet_their_texts_in_a_shuffle(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate((0, 59, 30))]
    rows += [(1, "another text of the same id"), (None, rows[0][1]), (7, None), (8, "lone words")]
    docs = spark.createDataFrame(rows, SHAPE)
    want = sorted(map(repr, jaccard.jaccard_join(docs).collect()))
    monkeypatch.setattr(jaccard, "FILTERED", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 1)
    assert sorted(map(repr, jaccard.jaccard_join(docs).collect())) == want


def test_lone_sets_share_no_node(spark):
    """Tokens of 64 bits: sets without a common shingle never meet, however many they are."""
    rows = [(i, " ".join(f"t{i}_{k}" for k in range(12))) for i in range(20_000)]
    heads = jaccard.sketches(spark.createDataFrame(rows, SHAPE), "doc_id", "text", 0.8, 11)
    nodes = heads.selectExpr("explode(heads) AS node").groupBy("node").count()
    assert nodes.filter("count > 1").isEmpty()


def test_runs_without_a_token_are_drawn_anew():
    choices = jaccard.Choices(0.8)
    tops = jaccard.roots(11, range(40), choices)
    assert len(set(tops.tolist())) == 40 and all(len(choices[int(t)]) for t in tops)
    assert jaccard.missed(tops[:4], choices, 0.8, 1) <= 0.01


def test_sizes_that_differ_too_much_are_not_compared(spark):
    members = spark.createDataFrame([(1, i, bytes([i]), i, 1, s) for i, s in enumerate((100, 101, 126, 400, 10_000))], "label long, id long, set_key binary, rep long, copies long, size long")
    tasks = jaccard.in_bands(members, 0.8).selectExpr("id", "explode(tasks) AS t").collect()
    together = {}
    for r in tasks:
        together.setdefault(tuple(r["t"])[:4], set()).add(r["id"])
    assert any({0, 1} <= x for x in together.values()) and not any(x & {0, 1, 2} and x & {3, 4} for x in together.values())


def test_first_runs_keep_the_recall_whatever_the_parameters():
    for similarity in (0.3, 0.5, 0.6, 0.7, 0.8, 0.95):
        for seed in range(1, 60):
            choices = jaccard.Choices(similarity)
            runs = jaccard.first_runs(seed, choices, similarity, 0.99)
            assert jaccard.missed(jaccard.roots(seed, runs, choices), choices, similarity, 1) <= 0.01
    assert jaccard.first_runs(11, jaccard.Choices(0.8), 0.8, 0.99) == range(jaccard.RUNS)


def test_recall_at_other_similarities(spark):
    """Pairs just above the threshold, nodes as small as they are shipped, seeds that once fell short."""
    random = np.random.default_rng(8)
    for similarity, seed in ((0.5, 3), (0.6, 4), (0.7, 5), (0.9, 6)):
        rows, pairs = [], 150
        for i in range(pairs):
            words = [f"w{i}_{k}" for k in range(204)]
            # n words in a row that differ break n + 4 of 200 shingles on each side.
            n = int(200 * (1 - similarity) / (1 + similarity)) - 5
            at = int(random.integers(10, 190 - n))
            rows += [(i, " ".join(words)), (pairs + i, " ".join(words[:at] + [f"y{i}_{k}" for k in range(n)] + words[at + n :]))]
        sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
        assert all(similarity <= len(sets[i] & sets[pairs + i]) / len(sets[i] | sets[pairs + i]) <= similarity + 0.03 for i in range(pairs))
        got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_join(spark.createDataFrame(rows, SHAPE), similarity=similarity, seed=seed).collect()}
        assert sum(got[i] == 1 and got[pairs + i] == 1 for i in range(pairs)) >= 0.95 * pairs, similarity
