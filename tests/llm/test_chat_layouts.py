"""Conversations as records of all layouts: each finds back to its turns by its own fingerprint."""

from pyspark.sql import functions as F

from fieldloom.llm import chat

SHAPE = "conv_id long, turn long, role string, text string"


def conversations():
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user", "user", "assistant"], ["user"], ["user", "assistant"] * 3, ["human", "gpt"], ["", "tool", "assistant"], ["gpt", "user", "assistant"]]
    texts = ["hi", "", "</turn>\n### user:\n\\", '{"messages": []}', "0", "é\u0000ü", None, "x" * 3000]
    return [(c, t, role, texts[(c + 3 * t) % len(texts)]) for c in range(800) for t, role in enumerate(shapes[c % len(shapes)])]


def test_every_layout_leads_back(spark):
    rows = spark.createDataFrame(conversations() + [(None, 0, None, None)], SHAPE)
    plain = chat.as_turns(rows).select("conv_id", "turns")
    found = chat.outlined_turns(chat.outlines(plain))
    got = {r["conv_id"]: r for r in found.collect()}
    assert {c: r["turns"] for c, r in got.items()} == {r["conv_id"]: r["turns"] for r in plain.collect()}
    assert {r["layout"] for r in got.values()} == {m.name for m in chat.MAPPINGS}
    assert len({r["layout_hash"] for r in got.values()}) == len(chat.MAPPINGS)
    # A layout is told by the row's own outline, not by the plan.
    assert got[5]["layout"] == got[13]["layout"] == "messages"
    want = {r["conv_id"]: tuple(r) for r in chat.digests(chat.read_back(chat.render(plain))).collect()}
    assert {r["conv_id"]: tuple(r) for r in chat.digests(chat.read_back(chat.render(found))).collect()} == want


def test_unknown_outlines_are_seen(spark):
    df = spark.createDataFrame([(1, '{"q": "0"}', ["user"], ["a"]), (2, None, ["user"], ["a"]), (3, '{"prompt": "0", "response": "7"}', ["user"], ["a"]), (4, "no json", [], [])], "conv_id long, outline string, roles array<string>, texts array<string>")
    got = {r["conv_id"]: (r["layout"], r["turns"]) for r in chat.outlined_turns(df).collect()}
    assert got[1] == got[2] == got[4] == (None, None)
    assert got[3][0] == "prompt_response" and [tuple(t) for t in got[3][1]] == [("user", "a")]
    assert chat.outlined_turns(df.limit(0)).isEmpty()


def test_outlines_are_short(spark):
    rows = spark.range(50_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t" * 50).alias("text"))
    found = chat.outlines(chat.as_turns(rows).select("conv_id", "turns"))
    assert found.select(F.max(F.length("outline"))).first()[0] < 100
    assert chat.outlined_turns(found).select(F.size("turns")).first()[0] == 50_000
