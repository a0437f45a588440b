"""What lies beyond the sizes that an operator holds at once: long items, texts and samples."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import contamination, oracles, quality, queries, tokens, toxicity

DOCS = "doc_id long, text string"


def brute(texts, items, window=13):
    out = {}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in texts.items():
        words, hit, ids = split(t), set(), set()
        for item, it in items:
            w = split(it)
            n = min(window, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[s : s + n]:
                        hit.update(range(p, p + n))
                        ids.add(item if item is None else str(item))
        out[i] = (len(words), len(hit), sorted(ids, key=lambda x: (x is None, x)))
    return out


def test_items_without_an_id_and_over_blocks(spark):
    long_item = " ".join(f"k{i % 37}" for i in range(400))
    items = [(1, "B c, D"), (None, "x y z"), (2, long_item), (2, "q r"), (3, None), (None, ""), (10, long_item[600:900])]
    texts = {0: "a b c d x y z", 1: long_item[300:700], 2: None, 3: "q r x y z " + long_item, 4: "nothing of it", 5: ""}
    docs = spark.createDataFrame([(i, t, i) for i, t in texts.items()], DOCS + ", hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for block_words in (90, 1000):
        got = contamination.decontaminate(docs, bench, block_words=block_words, unnamed=True, keep_text=True)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()} == want
        assert {r["doc_id"]: r["text"] for r in got.collect()} == texts
    assert contamination.decontaminate(docs.limit(0), bench, block_words=200).count() == 0


def test_query_counts_hits_of_items_without_an_id(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e"), (None, "a b c"), (2, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "a b c"), (7, "e")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    df = queries.op6_decontamination(spark, str(tmp_path))
    rows = con.execute(oracles.ORACLES["op6_decontamination"])
    names = [d[0] for d in rows.description]
    got = sorted(map(tuple, df.select(*names).collect()), key=repr)
    assert got == sorted(rows.fetchall(), key=repr) and any(r[1:3] == (5, 4) for r in got)


def test_a_long_text_does_not_empty_its_class(spark):
    rows = [(i, ("badword " if i % 2 else "fine ") + f"text {i}.") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(1, 2, 3, 4), F.repeat("text", 3000)).otherwise(F.col("text")))
    docs = docs.unionByName(docs.filter("doc_id = 7").crossJoin(spark.range(50)).drop("id"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1)], "doc_id long, toxic int")
    found = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 1000, 3000)
    n = [sum(y == c for _, y in found) for c in (0, 1)]
    assert all(60 <= x <= 100 for x in n) and all(len(t) < 3000 for t, _ in found)
    assert len({t for t, _ in found}) == len(found)
    with pytest.raises(ValueError, match="class"):
        toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 1000, 2)


def test_whole_words_are_features_and_null_ids_are_not_held_out(spark):
    assert toxicity.features("x" * 60 + "abc") != toxicity.features("x" * 60 + "abd")
    got = spark.createDataFrame([(None,), (0,)], "doc_id long").select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert [r["h"] for r in got][0] is False


def test_batches_of_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CHARS", 10)
    batch = ["a" * 4, "b" * 4, "c" * 4, "d" * 30, "", "e"]
    assert list(tokens.parts(batch)) == [(0, 2), (2, 3), (3, 4), (4, 6)] and list(tokens.parts([])) == []


def test_many_removed_lines_are_linear(spark):
    """A text of very many lines that all go, and of few: seconds, not hours."""
    import time

    n = 200_000
    shared = [f"boilerplate number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)} of all" for i in range(n)]
    rows = [(k, "\n".join(shared[: n if k in (5, 6) else 60]) + f"\nown words of {chr(97 + k)} here " * 9, "h") for k in range(26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    began = time.time()
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, min_docs=1).collect()}
    assert time.time() - began < 120
    own = [f"own words of {chr(97 + 5)} here " for _ in range(9)]
    assert got[6]["removed_words"] == 5 * n and [x for x in got[6]["clean_text"].split("\n") if x.startswith("boiler")] == []
    assert got[5]["removed_words"] == 5 * 60 and len(got[5]["clean_text"].split("\n")) == n - 60 + len(own)
    assert got[0]["clean_text"] == rows[0][1]


def test_repetitive_texts_and_items_are_linear():
    """Items and texts of one or two words over and over: as many look-ups as the text has words."""
    import random
    import time

    rng, began = random.Random(4), time.time()
    one = contamination.Block(["1"], [[b"w"] * 20_000])
    one.order({}, 13)
    assert contamination.merged([(a, b) for _, a, b in one.matches([b"w"] * 200_000, 13)]) == [(0, 200_000)]
    two = contamination.Block(["1"], [[rng.choice([b"v", b"w"]) for _ in range(5_000)]])
    two.order({}, 13)
    words = [rng.choice([b"v", b"w"]) for _ in range(50_000)]
    windows = {tuple(two.items[0][i : i + 13]) for i in range(5_000 - 12)}
    want = [(i, i + 13) for i in range(len(words) - 12) if tuple(words[i : i + 13]) in windows]
    assert sorted({(a, b) for _, a, b in two.matches(words, 13)}) == want
    assert time.time() - began < 30


@pytest.mark.parametrize("window", [1, 3, 6])
def test_windows_against_all_places(window):
    import random

    rng = random.Random(window)
    for _ in range(600):
        letters = [b"a", b"b", b"c", b"d"][: rng.randrange(1, 5)]
        items = [[rng.choice(letters) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        words = [rng.choice([*letters, b"x"]) for _ in range(rng.randrange(0, 40))]
        block = contamination.Block([str(i) for i in range(len(items))], items)
        block.order({x: rng.randrange(3) for x in letters}, window)
        want = set()
        for k, item in enumerate(items):
            span = min(window, len(item))
            own = {tuple(item[s : s + span]) for s in range(len(item) - span + 1)}
            want |= {(k, a, a + span) for a in range(len(words) - span + 1) if tuple(words[a : a + span]) in own}
        assert set(block.matches(words, window)) == want
