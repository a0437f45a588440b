"""Automata on formats with structure, held-out credentials, and a plain scanner of the base spans."""

import math
import random

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import secrets

HEX, BASE62 = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def made(seed, n, write):
    r = random.Random(seed)
    return [write(lambda letters, k: "".join(r.choice(letters) for _ in range(k))) for _ in range(n)]


FORMATS = {
    "hex": lambda pick: pick(HEX, 40),
    "prefixed": lambda pick: "sk_live_" + pick(BASE62, 24),
    "parts": lambda pick: f"{pick(HEX, 8)}-{pick(HEX, 4)}-{pick(HEX, 4)}-{pick(HEX, 12)}",
}


def test_states_tell_positions():
    for name, write in FORMATS.items():
        samples = made(1, 400, write)
        automaton = secrets.fitted(samples)
        assert automaton["states"] > 10, name
        # A token ends where it should, and hardly anywhere else.
        for x in made(2, 50, write):
            state, stops = 0, [automaton["stop"][0]]
            for c in x:
                state = automaton["edges"][state][c][1]
                stops.append(automaton["stop"][state])
            assert stops[-1] > math.log(0.9) and max(stops[:-1]) < math.log(0.01)
            assert secrets.likelihood(automaton, x + "0a") < secrets.likelihood(automaton, x) - 0.05
    parts = secrets.fitted(made(1, 400, FORMATS["parts"]))
    x = made(3, 1, FORMATS["parts"])[0]
    assert secrets.likelihood(parts, x.replace("-", "") + "---") < secrets.likelihood(parts, x) - 0.5
    assert secrets.likelihood(parts, "z" * 31) == -math.inf


def test_held_out_credentials_are_found_and_words_left():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    words = [w for t in texts for w in secrets.CANDIDATE.findall(t or "")]
    pairs = {}
    for t in texts:
        plain = "".join(c if "!" <= c <= "~" else " " for c in f" {t or ''} ")
        for a, b in zip(plain, plain[1:]):
            if b != " ":
                pairs[a + b] = pairs.get(a + b, 0) + 1
    model = {"automata": {k: secrets.fitted(made(4, 300, w)) for k, w in FORMATS.items()}, "plain": secrets.plain_model(pairs)}
    for name, write in FORMATS.items():
        fresh = made(5, 300, write)
        found = sum(bool(secrets.learned_spans(f"a {x} b", model, [], 0.5)) for x in fresh)
        assert found / len(fresh) >= 0.95, name
    false = [w for w in words if secrets.learned_spans(w, model, secrets.base_spans(w), 0.5)]
    assert len(false) / len(words) < 0.001, false[:20]


def test_letters_only_and_partly_covered_tokens_are_scored():
    write = lambda pick: pick("QXZJKVWqxzjkvw", 20)
    model = {"automata": {"k": secrets.fitted(made(6, 300, write))}, "plain": secrets.plain_model({"th": 50, " t": 50, "he": 50})}
    x = made(7, 1, write)[0]
    assert secrets.learned_spans(f"see {x}.", model, [], 0.5) == [(4, 24, "format")]
    assert secrets.learned_spans(x, model, [(0, 5, "hex")], 0.5) == [(0, 20, "format")]
    assert secrets.learned_spans(x, model, [(0, 5, "hex"), (0, 20, "assign")], 0.5) == []


def scanned(text):
    """The base spans, found character by character."""
    out, names = [], ("password", "passwd", "secret", "token", "apikey", "api_key")
    value = set(BASE62 + "+/_.=-")
    i = 0
    while i < len(text):
        # As the pattern's alternatives do, the first name that leads to a value counts.
        end = None
        for name in names:
            if len(text[i : i + len(name)]) == len(name) and all(a in (b, b.upper()) for a, b in zip(text[i : i + len(name)], name)):
                k = i + len(name)
                for skip in ((1, 0) if text[k : k + 1] in ("'", '"') and k < len(text) else (0,)):
                    j = k + skip
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] not in (":", "=") or j >= len(text):
                        continue
                    j += 1
                    blanks = j
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] in ("'", '"') and j < len(text):
                        j += 1
                    stop = j
                    while stop < len(text) and text[stop] in value:
                        stop += 1
                    if stop > j:
                        end = (j, stop)
                        break
                    del blanks
                if end:
                    break
        if end:
            if end[1] - end[0] >= 6:
                out.append((i, end[1], "assign"))
            i = end[1]
        else:
            i += 1
    for kind, head, letters, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set(HEX), 24)):
        i = 0
        while i < len(text):
            stop = i + len(head)
            if text[i:stop] == head and stop < len(text) and text[stop] in letters:
                while stop < len(text) and text[stop] in letters:
                    stop += 1
                if stop - i >= least:
                    out.append((i, stop, kind))
                i = stop
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


PIECES = ["password", "PassWD", "secret", "token", "api_key", "apikey", "API-KEY", '"', "'", " ", "  ", ":", "=", "\t", "abc123", "AKIA", "AKIA" + "B7" * 9, "ab01" * 7, "ſ", "K", "é", ".-", "/+"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_equal_a_plain_scanner(text):
    assert secrets.base_spans(text) == scanned(text)


def test_base_spans_of_all_documents():
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert secrets.base_spans(t or "") == scanned(t or "")


def test_redaction_is_linear_and_joins_overlaps():
    text = "ab" * 200_000
    spans = [{"start": i, "end": i + 3} for i in range(0, 400_000, 2)]
    assert secrets.redacted(text, spans) == "[SECRET]"
    assert secrets.redacted("0123456789", [{"start": 1, "end": 4}, {"start": 2, "end": 3}, {"start": 6, "end": 7}]) == "0[SECRET]45[SECRET]789"


def planted(spark, n_labelled, n_bare, seed):
    """Documents of words; some assign a credential, others hold one of the same format that nothing assigns."""
    r = random.Random(seed)
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist() if t and not secrets.base_spans(t)]
    words = [w for t in texts for w in t.split() if w.isascii()]
    write = {"prefixed": lambda: "sk_live_" + "".join(r.choice(BASE62) for _ in range(24)), "parts": lambda: "-".join("".join(r.choice(BASE62[10:36]) for _ in range(6)) for _ in range(4))}
    rows, bare = [], {}
    for i in range(n_labelled + n_bare):
        value = write["prefixed" if i % 2 else "parts"]()
        said = r.sample(words, 120)
        if i < n_labelled:
            said.insert(60, f'api_key = "{value}"')
        else:
            said.insert(60, value)
            bare[i] = value
        rows.append((i, " ".join(said)))
    rows += [(-1 - i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string"), bare


def test_formats_that_the_base_patterns_miss(spark):
    """Learned from the documents' own labels, through the operator: few labels or many."""
    for n_labelled, least in ((6, 0.9), (16, 0.95), (200, 0.98)):
        docs, bare = planted(spark, n_labelled, 100, n_labelled)
        model = secrets.learn(docs)
        assert model["automata"]
        found = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["secrets"] if s["kind"] == "format"] for r in secrets.find_secrets(docs, model).collect()}
        hits = sum(value in found[i] for i, value in bare.items())
        strange = sum(len(v) for i, v in found.items()) - hits
        assert hits / len(bare) >= least, (n_labelled, hits)
        assert strange <= 5, (n_labelled, strange, [x for v in found.values() for x in v if x not in bare.values()][:30])


def test_one_credential_is_a_format(spark):
    docs = spark.createDataFrame([(1, "token = 3f8a9c1e77b2d04455aa says"), (2, "plain words and nothing else here")], "doc_id long, text string")
    model = secrets.learn(docs)
    assert [a["samples"] for a in model["automata"].values()] == [1]
    assert secrets.learn(docs.filter("doc_id = 2"))["automata"] == {}
    assert secrets.find_secrets(docs, secrets.learn(docs.limit(0))).filter("size(secrets) > 1").isEmpty()
