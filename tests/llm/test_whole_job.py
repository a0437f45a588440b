"""Cases in which an operator once did less than its whole job."""

import collections
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import chat, lm, queries, warc


def plain_losses(made):
    """Both mean losses of each text, counted without any hashing."""
    c, pairs = ([collections.Counter(), collections.Counter()] for _ in range(2))
    for text, hit in made:
        words = ["<s>", *text.split()]
        for k in [1] + [0] * hit:
            c[k].update(words)
            pairs[k].update(zip(words, words[1:]))
    scale, used = [1, sum(c[0].values()) / sum(c[1].values())], len(c[1])
    for text, _ in made:
        words, out = ["<s>", *text.split()], []
        for k in range(2):
            n = scale[k] * sum(c[k].values())
            p = [0.7 * (pairs[k][a, b] / c[k][a] if c[k][a] else 0) + 0.3 * (scale[k] * c[k][b] + 1) / (n + used) for a, b in zip(words, words[1:])]
            out.append(-np.log(p).mean())
        yield out


def test_lm_words_and_bigrams_share_no_counts(spark, monkeypatch):
    """More words and bigrams than 2^18 and 2^20 places would keep apart, over several groups."""
    seen, same = {}, []
    for i in range(20_000):
        place = zlib.crc32(f"w{i}".encode()) % ((1 << 18) - 1)
        if place in seen:
            same.append((f"w{seen[place]}", f"w{i}"))
        seen[place] = i
    made = [(" ".join([a, a, b, "x"]), False) if i % 2 else (" ".join([a, "x", a, "x"]), True) for i, (a, b) in enumerate(same[:200])]
    made += [(" ".join([b, "x", b]), False) for _, b in same[:200]]
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(made)], "doc_id long, text string, is_target boolean")
    want = list(plain_losses(made))
    for size in (1 << 24, 1000):
        monkeypatch.setattr(lm, "GROUP_BYTES", size, raising=False)
        got = [lm.cross_entropy_difference(docs, lm.fit(docs))]
        if hasattr(lm, "cross_entropy_of_corpus"):
            got.append(lm.cross_entropy_of_corpus(docs.drop("is_target"), docs.filter("is_target")))
        for df in got:
            rows = {r["doc_id"]: (r["target_loss"], r["background_loss"]) for r in df.collect()}
            assert np.allclose([rows[i] for i in range(len(made))], want, atol=1e-4)


def test_lines_above_limits_leave_the_texts(spark):
    """A line of more than 20 documents of a host stays with its first holder only."""
    own = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(30)]
    made = [(i, f"{t}\n  All Rights  reserved 20{i:02d}\n\n{t[::-1]}", "en", "h", 7) for i, t in enumerate(own)]
    made += [(99, own[0] + " b\nall rights reserved 2000", "en", "other", 7)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.quality_stage(spark, docs, "").collect()}
    assert len(got) == len(made)
    for i, t in enumerate(own):
        want = made[0][1] if i == 0 else f"{t}\n\n{t[::-1]}"
        assert got[i]["text"] == want and got[i]["n_chars"] == (7 if i == 0 else len(want))
    assert got[99]["text"] == made[-1][1] and got[99]["n_chars"] == 7


LONG = 20_000_001


def test_a_very_long_turn_is_formatted(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    rows.withColumn("text", F.when(F.col("turn") == 1, F.repeat(F.lit("a"), F.lit(LONG))).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op9_chat_formatting(spark, str(tmp_path)).filter("conv_id = 1").first()
    assert (got["n_turns"], got["loss_chars"]) == (2, LONG) and got["formatted_chars"] == LONG + 1 + 13 + 2 * 14


def test_a_record_beyond_the_parsers_is_an_error(spark):
    record = F.concat(F.lit('{"prompt": "q", "response": "'), F.repeat(F.lit("a"), F.lit(LONG)), F.lit('"}'))
    with pytest.raises(Exception, match="does not parse"):
        chat.format_chats(spark.range(1).select(record.alias("record"))).select("layout").collect()


def test_warc_keeps_all_headers_links_and_the_charset():
    page = "<title>caf\u00e9</title><script src='/s.js'>document.write(\"<a href='no'>\")</script><!-- <a href='no'> --><noscript>hidden<img src=i.png></noscript><p>x".encode("cp1252")
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie:b=2\r\nContent-type:text/html; charset=ISO-8859-1\r\n\r\n" + page
    head = f"WARC/1.1\r\nWARC-Type:response\r\nWARC-Target-URI: http://a.b/\r\nWARC-Concurrent-To: <x>\r\nWARC-Concurrent-To: <y>\r\ncontent-length:{len(block)}\r\n\r\n"
    (_, metadata), (_, text) = warc.derive(head.encode() + block + b"\r\n\r\n")
    told = json.loads(metadata)["Envelope"]
    http = told["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert told["Actual-Content-Length"] == len(block)
    assert [v for k, v in told["WARC-Header-Metadata"] if k == "WARC-Concurrent-To"] == ["<x>", "<y>"]
    assert http["Headers"][:2] == [["Set-Cookie", "a=1"], ["set-cookie", "b=2"]]
    assert http["HTML-Metadata"] == {"Title": "caf\u00e9", "Links": [{"path": "SCRIPT@/src", "url": "http://a.b/s.js"}, {"path": "IMG@/src", "url": "http://a.b/i.png"}]}
    assert text.decode() == "caf\u00e9\nx"
