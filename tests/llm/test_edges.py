"""Every operator on nulls, empty and long texts, ties, repeated rows, no rows, extra columns."""

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat, contamination, jaccard, lm, mixing, quality, secrets, tokens, toxicity, warc

P = pytest.importorskip("public_tokenizers")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, score string"
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))


def rows():
    texts = [None, "", " \n\t ", "one", LONG, "a b c d e f g h i j", "a b c d e f g h i j", "password = abcdef123 x", "é\u0000ü 🤦 \x85"]
    made = [(i, t, "en", ["s", None, "t"][i % 3], 1, "clash", None, "clash") for i, t in enumerate(texts)]
    return made + [made[5], (None, "a b c d e f g h i j", None, None, None, None, None, None)]


@pytest.fixture(params=["full", "empty"])
def docs(spark, request):
    return spark.createDataFrame(rows() if request.param == "full" else [], SHAPE)


def test_quality(docs):
    got = quality.quality_rules(docs)
    assert got.count() == docs.count() and got.filter("kept IS NULL OR base_failed IS NULL").isEmpty()
    assert got.filter("kept").count() == got.filter("kept AND NOT base_failed").count()


def test_mixing(docs):
    documents, segments = mixing.mix(docs)
    got = mixing.taken(documents, segments)
    assert got.count() == docs.count() and got.filter("taken > 2 * size").isEmpty()
    assert got.filter("size = 0 AND taken > 0").isEmpty()
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect():
        assert r["t"] == round(r["w"])


def test_jaccard(docs):
    got = jaccard.jaccard_join(docs)
    assert got.count() == docs.count()
    by_id = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()}
    if by_id:
        assert by_id[0] == (0, 0) and by_id[1] == (1, 0) and by_id[4] == (4, 0)
        assert by_id[6] == (5, 3) and by_id[None] == (5, 3)


def test_secrets(docs):
    model = secrets.learn(docs)
    got = secrets.find_secrets(docs, model)
    assert got.count() == docs.count() and got.filter("secrets IS NULL").isEmpty()
    assert secrets.redact(got).filter("text LIKE '%abcdef123%'").isEmpty()


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (6, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    assert got.count() == docs.count() and got.filter("score IS NULL OR score < 0 OR score > 1").isEmpty()


def test_contamination(spark, docs):
    items = spark.createDataFrame([(1, "B c, D"), (1, None), (None, "a"), (2, ""), (10, "g h i j")], "item_id long, text string")
    for block_words in (1, 1000):
        got = {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in contamination.decontaminate(docs, items, block_words=block_words).collect()}
        if not docs.isEmpty():
            assert (6, 7, ("1", "10")) in got and (0, 0, ()) in got and (4, 0, ()) in got
    assert contamination.decontaminate(docs, items.limit(0)).filter("contaminated").isEmpty()


def test_tokens(docs):
    got = tokens.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert got.count() == docs.count() and got.filter("n_tokens IS NULL OR n_tokens > n_bytes").isEmpty()
    assert got.filter("doc_id < 2 AND n_tokens > 0").isEmpty()


def test_lm(docs):
    flagged = docs.withColumn("is_target", F.when(F.col("doc_id") > 3, F.col("doc_id") % 2 == 0))
    got = lm.cross_entropy_difference(docs, lm.fit(flagged))
    assert got.count() == docs.count() and got.filter("score IS NULL OR isnan(score)").isEmpty()


def test_chat(spark):
    shape = "conv_id long, turn long, role string, text string, record string"
    made = [(1, 1, "assistant", None, "x"), (1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (2, None, None, "", None), (None, 0, "assistant", "</turn>\n### user:\n\\", None)]
    for data in (made, []):
        table = spark.createDataFrame(data, shape)
        got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_chats(chat.as_records(table)))).collect()}
        assert len(got) == (3 if data else 0)
        if data:
            assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == len(made[4][3])


def test_warc(spark):
    shape = "page_id long, url string, html string, record string, response string"
    made = [(1, "http://a.b/\r\nX: y", "<title>T</title><p>x<a href='/q'>", "clash", "clash"), (2, None, None, None, None), (3, "http://[", "<a href=\"http://[\">", None, None)]
    for data in (made, made[:0]):
        pages = spark.createDataFrame(data, shape)
        got = warc.derivatives(warc.responses(pages)).collect()
        assert len(got) == 2 * len(data)
        for r in got:
            headers, block = warc.parse_record(bytes(r["record"]))
            assert headers["WARC-Refers-To"] == r["refers_to"] and headers["WARC-Block-Digest"] == warc.digest(block) == r["block_digest"]
            assert "X" not in headers
