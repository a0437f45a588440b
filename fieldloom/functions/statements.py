"""Statements that map ids to names, cut out of whole texts in one linear pass each.

A statement begins at its key (``CASE WHEN itemid = …``) and ends at the first closing
after it (``END AS name``), whatever stands between. A lazy pattern over both ends scans
to the end of the text for each beginning that has no closing. Here what follows a key is
taken a character at a time up to a closing or the end, and never given back: each
character of a text is read once, and a statement without a closing is one without a name.
The groups are then told from the statements, which are short.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V

#: In the place of brackets that none closes.
HIDDEN = "\x01"


class Kind(NamedTuple):
    """A kind of statement: its pattern, and the groups of what it holds.

    ``read`` is the text that it is found in: up to the last closing, or all lines.
    ``ones`` are the groups of the only id, or of both levels of it; ``many`` the group of
    a list in which ``ids`` finds each; ``name`` that of the name; ``between`` that of what
    stands between, which may be at most ``longest``.
    """

    label: str
    read: str
    pattern: str
    ones: tuple[int, ...]
    many: int | None
    ids: str
    name: int
    between: int | None
    longest: int


def closed_brackets(text: Column) -> Column:
    """A text whose open brackets behind its last closing one are hidden.

    A list that no bracket closes would be looked for to the end of the text each time.
    """
    last = F.length(text) - F.instr(F.reverse(text), ")") + 1
    rest = F.translate(F.substr(text, last + 1), "(", HIDDEN)
    return F.when(F.instr(text, ")") == 0, F.translate(text, "(", HIDDEN)).otherwise(F.concat(F.substr(text, F.lit(1), last), rest))


def to_last_closing(text: Column) -> Column:
    """A text up to its last closing, in which every key before that one finds one: '' without any.

    Of the brackets before it, those that close behind it are hidden.
    """
    head = F.regexp_extract(text, f"(?is)^(.*){V.CLOSING}", 1)
    closing = F.regexp_extract(text, f"(?is)^.*({V.CLOSING})", 1)
    return F.concat(closed_brackets(head), closing)


def triples(texts: DataFrame, db: str, text: str, file: str) -> DataFrame:
    """(db, field_key, concept_raw, src_file, pattern) of all statements; null texts have none."""
    told = F.coalesce(F.col(text), F.lit(""))
    whole = texts.select(F.col(db).alias("db"), F.col(file).alias("src_file"), closed_brackets(told).alias("_lines"), to_last_closing(told).alias("_closed"))
    out = None
    for kind in (Kind(*k) for k in V.STATEMENT_KINDS):
        found = whole.select("db", "src_file", F.explode(F.regexp_extract_all(kind.read, F.lit(kind.pattern), F.lit(0))).alias("_s"))

        def group(n: int, kind: Kind = kind) -> Column:
            return F.regexp_extract("_s", kind.pattern, n)

        name = F.translate(group(kind.name), HIDDEN, "(")
        told = found.filter(name != "")
        if kind.between is not None:
            told = told.filter(F.length(group(kind.between)) <= kind.longest)
        one = F.concat_ws("|", *map(group, kind.ones))
        keys = F.array(one)
        if kind.many is not None:
            several = F.regexp_extract_all(group(kind.many), F.lit(kind.ids), F.lit(1))
            keys = F.when(one != "", keys).otherwise(several)
        rows = told.select("db", F.explode(keys).alias("field_key"), F.trim(name).alias("concept_raw"), "src_file", F.lit(kind.label).alias("pattern"))
        out = rows if out is None else out.unionByName(rows)
    return out
