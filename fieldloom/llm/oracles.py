"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

#: Words of whole texts, as ``words`` splits them.
WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents
), base AS (
  SELECT r, doc_id, host, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols
  FROM d
), dup AS (
  SELECT r, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
  GROUP BY r
), windows AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), repeated AS (
  SELECT r, i FROM windows JOIN (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1) USING (r, g)
), covered AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY r
), lines AS (
  SELECT r, host, t, coalesce(doc_id, 9223372036854775807) AS id, trim(l) AS l FROM (
    SELECT r, host, t, doc_id, unnest(string_split(
      regexp_replace(regexp_replace(lower(t), '[0-9]', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) AS l
    FROM d) WHERE trim(l) <> ''
), held AS (
  SELECT host, t, l, min(id) AS first_id FROM lines GROUP BY ALL
), hosts AS (
  SELECT host, count(DISTINCT t) AS host_docs FROM held GROUP BY host
), above AS (
  SELECT host, l, min(first_id) AS holder FROM held JOIN hosts USING (host)
  GROUP BY host, l, host_docs HAVING count(*) > 20 AND count(*) > 0.005 * host_docs
), removed AS (
  SELECT x.r, sum(len(string_split(x.l, ' ')))::BIGINT AS removed_words
  FROM lines x JOIN held USING (host, t, l) JOIN above USING (host, l) WHERE first_id <> holder GROUP BY x.r
)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
       coalesce(n_repeat_words, 0) AS n_repeat_words,
       n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words)
         AND n_words - coalesce(removed_words, 0) >= 0.3 * n_words AS kept,
       coalesce(removed_words, 0) AS removed_words
FROM base LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
"""

ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH item AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOWER}, '{ITEM_WORD}') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size,
         array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), size AS (SELECT DISTINCT size FROM item_window),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{ITEM_WORD}') AS w FROM documents
), doc_window AS (
  SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, size WHERE len(w) >= size)
), hit AS (
  SELECT r, i, size, item_id FROM doc_window JOIN item_window USING (size, g)
), words AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</', '<\/'), ':' || chr(10), ':\' || chr(10)) AS r,
    replace(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</', '<\/'), ':' || chr(10), ':\' || chr(10)) AS x
  FROM t
), a AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(r) + length(x) + 14)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM a
"""

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, i, line, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d)
), often AS (
  SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM (SELECT r, l.doc_id, i, line, holder IS NOT NULL AND holder <> l.doc_id AS dropped FROM l LEFT JOIN often USING (k))
GROUP BY r, doc_id
"""

#: CRC-32 of ASCII text: each byte, then each of its bits.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""
NL = "chr(10)"


def _insert(into: str) -> str:
    """Best continuations with an insertion first, from those of ``into``; states as in the grammar."""
    said = {2: "user", 3: "assistant"}
    led = (2, 2, 3, 2)
    made = [f"{{'c': {into}[{to + 1}].c + 2, 'a': 'I' || {into}[{to + 1}].a, 'r': {NL} || '{said[to]}:' || {into}[{to + 1}].r}}" for to in led]
    return "[" + ", ".join(f"list_min([w[{g + 1}], {m}])" for g, m in enumerate(made)) + "]"


def _read(g: int, keeps: dict[str, int], to: int, role: str) -> str:
    """The best of deleting, keeping and reroling a turn in a state."""
    ragged = "(fault = 'truncated')::INT"
    kept = " ".join(f"WHEN '{x}' THEN {{'c': s[{t + 1}].c + {ragged}, 'a': 'K' || s[{t + 1}].a, 'r': {NL} || role || ':' || text || s[{t + 1}].r}}" for x, t in keeps.items())
    reroled = f"{{'c': s[{to + 1}].c + 2 + {ragged}, 'a': 'R' || s[{to + 1}].a, 'r': {NL} || '{role}:' || text || s[{to + 1}].r}}"
    gone = f"{{'c': s[{g + 1}].c + 3, 'a': 'D' || s[{g + 1}].a, 'r': s[{g + 1}].r}}"
    return f"""list_min(list_filter([{gone}, CASE WHEN fault IN ('fine', 'truncated') THEN CASE initial {kept} END END,
  CASE WHEN fault IN ('fine', 'truncated') THEN {reroled} END], lambda x: x IS NOT NULL))"""


_READ = ", ".join((_read(0, {"s": 1, "u": 2}, 2, "user"), _read(1, {"u": 2}, 2, "user"), _read(2, {"a": 3}, 3, "assistant"), _read(3, {"u": 2}, 2, "user")))

OP12 = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (SELECT *, {CRC} % 20 AS kind FROM d),
h AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), o AS (
  SELECT *, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || {NL} || text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM h
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE 'fine' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS adjacent
  FROM o
), r AS (
  SELECT DISTINCT conv_id, n AS i, [{{'c': 0, 'a': '', 'r': ''}}, {{'c': 4, 'a': 'II', 'r': {NL} || 'user:' || {NL} || 'assistant:'}},
         {{'c': 2, 'a': 'I', 'r': {NL} || 'assistant:'}}, {{'c': 0, 'a': '', 'r': ''}}] AS s FROM f
  UNION ALL
  SELECT conv_id, i, {_insert("u")} FROM (SELECT conv_id, i, w, {_insert("v")} AS u FROM (SELECT conv_id, i, w, {_insert("w")} AS v FROM (
    SELECT r.conv_id, r.i - 1 AS i, [{_READ}] AS w FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i)))
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (adjacent NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(r.s[1].c, 0)::BIGINT AS cost, coalesce(r.s[1].a, '') AS audit, sha256(coalesce(substr(r.s[1].r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = 0
"""

OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, c.r AS c, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.q, c.q)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.r <> c.r AND len(a.q) = len(c.q)
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT s.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY s.a, p.k ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM s JOIN p USING (a) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT * FROM n WHERE rank <= 3
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op6_decontamination": OP6,
    "op9_chat_formatting": OP9,
    "op11_line_dedup": OP11,
    "op12_conversation_repair": OP12,
    "op13_hard_negatives": OP13,
}
