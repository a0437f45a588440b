"""Long conversations, deep records and tables of several layouts."""

import hashlib
import json
import time

from pyspark.sql import functions as F

from fieldloom.llm import chat, queries


def test_a_hundred_thousand_turns_take_seconds(spark):
    n = 100_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    text = F.concat(F.lit("</turn>\n### "), F.col("id").cast("string"), F.lit(" \U0001f926"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    began = time.perf_counter()
    got = chat.digests(chat.read_back(chat.render(chat.as_turns(rows)))).first()
    took = time.perf_counter() - began
    said = [f"</turn>\n### {i} \U0001f926" for i in range(n)]
    loss = "".join(said[1::2])
    assert got["n_turns"] == n and got["loss_chars"] == len(loss) and took < 60
    assert got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    turns = "".join(f"{('user', 'assistant')[i % 2]}\n{t}\n" for i, t in enumerate(said))
    assert got["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()


def test_paths_of_any_depth(spark):
    deep = {"a": {"b": {"c": {"d": [{"e": [{"f": 1}, {"g": {"h": None}}]}]}}}, "`x y`": {"z.w": 1}, "n": [[{"m": 1}]], "s": [1, 2]}
    want = {"a", "a.b", "a.b.c", "a.b.c.d", "a.b.c.d[].e", "a.b.c.d[].e[].f", "a.b.c.d[].e[].g", "a.b.c.d[].e[].g.h", "`x y`", "`x y`.z.w", "n", "n[][].m", "s"}
    odd = [json.dumps(deep), "[1]", "no json", None, "{}", json.dumps({"k": [{"a": 1}, "plain"]})]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, record string")
    got = {r["i"]: r["p"] for r in df.select("i", chat.field_paths(F.col("record")).alias("p")).collect()}
    assert set(got[0]) == want and got[1] == got[2] == got[3] == got[4] == [] and got[5] == ["k"]
    deeper = {"data": {"question": "q", "answer": "a", "meta": {"source": {"page": 1}}}}
    plain = {"data": {"question": "q", "answer": "a"}}
    df = spark.createDataFrame([(json.dumps(deeper),), (json.dumps(plain),)], "record string")
    assert [r["layout"] for r in chat.canonical_turns(df).collect()] == [None, "nested_exchange"]


def test_tables_of_several_layouts_give_the_same(spark, tmp_path):
    """As the query reads them: rows under other field names, with other columns beside."""
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, 0, "assistant", None), (2, None, None, "x")]
    plain = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    plain.write.parquet(f"{tmp_path}/conversations.parquet")
    want = {r["conv_id"]: r for r in queries.op9_chat_formatting(spark, str(tmp_path)).collect()}
    assert want[-7]["n_turns"] == 2 and want[None]["n_turns"] == 1 and len(want) == 4
    other = plain.select("conv_id", "turn", F.col("role").alias("role"), F.col("text").alias("content"), F.lit("clash").alias("layout"))
    human = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    shared = plain.select("conv_id", "turn", human.alias("from"), F.col("text").alias("value"))
    for rows, layout in ((plain, "turn_rows"), (other, "message_rows"), (shared, "shared_turn_rows")):
        found = chat.as_turns(rows)
        assert {r["layout"] for r in found.collect()} == {layout}
        for r in chat.digests(chat.read_back(chat.render(found))).collect():
            assert r == want[r["conv_id"]]
    unknown = chat.as_turns(plain.withColumnsRenamed({"text": "utterance"})).collect()
    assert all(r["layout"] is None and r["turns"] is None for r in unknown)


def test_spans_lie_in_the_formatted_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "a</b"), (1, 1, "assistant", "c##"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    r = chat.render(chat.as_turns(df)).first()
    at, found = 0, []
    for span in r["loss_mask"]:
        if span["first"] is not None:
            found.append(r["formatted"][at + span["first"] - 1 :][: span["chars"]])
        at += span["of"]
    assert at == len(r["formatted"]) and found == ["c#\\#", ""]
