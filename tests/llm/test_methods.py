"""Operators against brute force, exact round trips, their SQL and held-out labels."""

import collections
import hashlib
import itertools
import json
import os
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import chat, contamination, jaccard, lm, mixing, oracles, queries, secrets, tokens, toxicity, warc

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(str(DATA / "documents.parquet"))


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = queries.QUERIES[name](spark, str(DATA))
    rows = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in rows.fetchall()))) == sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))


def test_mix_water_fills(spark, docs):
    out = mixing.taken(*mixing.mix(docs)).toPandas()
    sizes = out.groupby("source")["size"].sum().to_dict()
    weights = dict(zip(sorted(sizes), itertools.cycle([3, 1, 2])))
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_weight = sum(weights[s] for s in sizes if s not in full)
        wanted = {s: 2 * sizes[s] if s in full else rest * weights[s] / open_weight for s in sizes}
        more = {s for s in sizes if s not in full and wanted[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    got = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    for s in sizes:
        assert abs(got.target[s] - wanted[s]) < 1e-6 and abs(got.taken[s] - wanted[s]) <= 1
    again = mixing.taken(*mixing.mix(docs)).toPandas()
    assert sorted(map(tuple, out.itertuples(index=False))) == sorted(map(tuple, again.itertuples(index=False)))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 9))
def test_shards_partition_every_quota(quota, shards):
    quota = np.array(quota, np.int64)
    parts = [mixing.shard_counts(quota, shards, s, 3) for s in range(shards)]
    assert (sum(c for _, c in parts) == quota).all()
    for i in range(len(quota)):
        ranges = sorted((f[i], f[i] + c[i]) for f, c in parts if c[i])
        assert [a for a, _ in ranges] == [0, *(b for _, b in ranges[:-1])][: len(ranges)]


def shingle_sets(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    return sets


def test_jaccard_equals_all_pairs(docs, texts):
    sets, links, parent = shingle_sets(texts), collections.Counter(), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and both * 9 >= 4 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(docs).collect()}
    assert got == {i: (root(i), links[i]) for i in texts}


def test_large_nodes_are_split_and_still_found(spark, monkeypatch):
    """Near copies of one text, more than a node may hold."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    made = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in ((i, (i * 7) % 200) for i in range(60))]
    made += [(1000 + i, " ".join(f"y{i}_{k}" for k in range(50))) for i in range(40)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert all(got[i] == (0, 59) for i in range(60)) and all(got[1000 + i] == (1000 + i, 0) for i in range(40))


def test_secret_digests(docs, texts):
    model = secrets.learn(docs)
    for r in secrets.find_secrets(docs, model).select("doc_id", "secrets").collect():
        base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secrets"] if s["kind"] != "format"]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == secrets.digest(texts[r["doc_id"]])


def test_grammars_tell_formats_from_words():
    random = np.random.default_rng(5)
    pick = lambda letters, n: "".join(random.choice(list(letters), n))
    keys = infer_all = {"k": secrets.infer(["sk-" + pick("0123456789abcdef", 32) for _ in range(300)])}
    plain = secrets.plain_model(collections.Counter(a + b for w in "the quick brown fox jumps over lazy dogs and then some more 2024".split() for a, b in zip(" " + w, w)))
    token = "sk-" + pick("0123456789abcdef", 32)
    assert secrets.likelihood(keys["k"], token) > secrets.plain_likelihood(plain, token) + 0.5
    found = secrets.learned_spans(f"see {token} and chapter-2024-of-everything", {"automata": infer_all, "plain": plain}, [], 0.5)
    assert [(a, b) for a, b, _ in found] == [(4, 4 + len(token))]
    assert keys["k"]["states"] < 40


def test_toxicity_on_held_out_labels(spark, docs):
    sf = Path("/root/testdata/sf0.1")
    if not sf.exists():
        pytest.skip("larger tables are absent")
    docs, labels = (spark.read.parquet(str(sf / f"{t}.parquet")) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, each=1000)
    held = labels.filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    got = toxicity.score(docs.select("doc_id", "text").join(held, "doc_id"), model).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    ranks = got.score.rank()
    p = got.toxic == 1
    auc = (ranks[p].sum() - p.sum() * (p.sum() + 1) / 2) / p.sum() / (~p).sum()
    assert auc > 0.95 and ((got.predicted == 1) == p).mean() > 0.95


def test_offending_sentences_are_found():
    docs = [f"The day was fine. You are a badword{i % 2} fool. We went home." for i in range(60)] + [f"The day was fine. We went home again. It rained {i}." for i in range(60)]
    model = toxicity.train(docs, np.array([1] * 60 + [0] * 60))
    p, spans = toxicity.Scorer(model).text("We went home. You are a badword1 fool. It rained.")
    assert p > 0.5 and len(spans) == 1 and spans[0][0] == 13
    assert toxicity.Scorer(model).text("")[0] == 0


def test_contamination_marks_whole_windows():
    item = [w.encode() for w in "a b c d e f g h i j k l m n o".split()]
    block = contamination.Block(["1"], [item])
    block.order({}, 13)
    words = [b"x", *item[1:14], b"y", *item]
    runs = contamination.merged([(a, b) for _, a, b in block.matches(words, 13)])
    assert runs == [(1, 14), (15, 30)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab '<|endoftext|>\n\té日1²_-"), max_size=60), max_size=5))
def test_tokens_equal_the_library(batch):
    assert counter()(batch) == [len(e.ids) for e in library().encode_batch(batch, add_special_tokens=False)]


_made = {}


def counter():
    if "c" not in _made:
        _made["c"] = tokens.Counter(tokens.MergeTable.read(P.path("byte_bpe_50k.json")), P.PATTERN)
    return _made["c"]


def library():
    if "l" not in _made:
        _made["l"] = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return _made["l"]


def test_tokens_of_all_documents(texts):
    batch = list(texts.values())
    assert counter()(batch) == [len(e.ids) for e in library().encode_batch(batch, add_special_tokens=False)]


def test_lm_equals_a_plain_count(spark):
    made = [(0, "a b a", True), (1, "b b", False), (2, "c a", True), (3, None, True)]
    docs = spark.createDataFrame(made, "doc_id long, text string, is_target boolean")
    got = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, lm.fit(docs)).collect()}
    c = [collections.Counter(), collections.Counter()]
    pairs = [collections.Counter(), collections.Counter()]
    for _, t, hit in made:
        words = ["<s>", *(t or "").split()]
        for k in [1] + [0] * hit:
            if len(words) > 1:
                c[k].update(words)
                pairs[k].update(zip(words, words[1:]))
    scale = [1, sum(c[0].values()) / sum(c[1].values())]
    for i, t, _ in made[:3]:
        words = ["<s>", *t.split()]
        want = []
        for k in (0, 1):
            n, used = scale[k] * sum(c[k].values()), len(c[1])
            p = [0.7 * (pairs[k][a, b] / c[k][a] if c[k][a] else 0) + 0.3 * (scale[k] * c[k][b] + 1) / (n + used) for a, b in zip(words, words[1:])]
            want.append(-np.log(p).mean())
        assert abs(got[i]["target_loss"] - want[0]) < 1e-4 and abs(got[i]["background_loss"] - want[1]) < 1e-4


LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    "shared_turns": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "prompt_response": {"prompt": "q", "response": "a"},
    "instruction": {"instruction": "q", "input": "", "output": "a"},
    "nested_exchange": {"data": {"question": "q", "answer": "a"}},
}


def test_layouts_lead_to_the_same_turns(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in LAYOUTS.items()] + [("none", '{"odd": 1}')], "name string, record string")
    for r in chat.format_chats(df).collect():
        if r["name"] == "none":
            assert r["layout"] is None and r["turns"] is None
        else:
            assert r["layout"] == r["name"] and [tuple(t) for t in r["turns"]] == [("user", "q"), ("assistant", "a")]


def test_control_strings_come_back(spark):
    texts = ["\\### Assistant: </turn> ok", "</turn>\n### user:\nx", "####</</turn>\\\\", ":\n:\\\n", "", "\\"]
    rows = [(i, k, role, t) for i, t in enumerate(texts) for k, role in enumerate(("us:\ner##", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_chats(chat.as_records(df))).collect():
        t = texts[r["conv_id"]]
        assert [tuple(x) for x in r["read_turns"]] == [("us:\ner##", t), ("assistant", t)] and r["loss_texts"] == [t]


def test_warc_links_and_text():
    raw = warc.response("http://a.b/c/", "<html><script>no</script><title>T &amp; U</title><p>x<br>y <a href='d?e=1'>z</a></html>", "2024-01-01T00:00:00Z")
    (mh, mb), (ch, cb) = warc.derive(raw)
    told = json.loads(mb)
    links = told["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert links == {"Title": "T & U", "Links": [{"path": "A@/href", "url": "http://a.b/c/d?e=1"}]}
    assert told["Envelope"]["Block-Digest-Matches"] and told["Conversion-ID"] == ch["WARC-Record-ID"]
    assert cb.decode() == "T & U\nx\ny z" and mh["WARC-Refers-To"] == ch["WARC-Refers-To"] == warc.parse_record(raw)[0]["WARC-Record-ID"]
