"""Names, concepts, cards and mappings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .portable import last_segment, lookup


def normalize_name(name: Column) -> Column:
    """Lower case, last segment, letters and digits only, abbreviations spelt out."""
    plain = last_segment(F.lower(F.coalesce(name, F.lit(""))))
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]+", " "), r"\s+", " "))
    spelt = F.transform(F.split(plain, " "), lambda w: F.coalesce(lookup(w, V.NAME_ABBREVIATIONS), w))
    return F.coalesce(lookup(plain, V.NAME_ABBREVIATIONS), F.array_join(spelt, " "))


def normalize_concept(raw: Column) -> Column:
    """Underscored lower case without quotes and aggregate suffixes; synonyms resolved."""
    s = F.lower(F.btrim(F.trim(raw), F.lit("'\"")))
    s = F.btrim(F.regexp_replace(F.regexp_replace(s, r"[\s\-/().,]+", "_"), "_+", "_"), F.lit("_"))
    for _ in range(3):
        s = F.regexp_replace(s, V.AGGREGATE_SUFFIX, "")
    return F.coalesce(lookup(F.replace(s, F.lit("_")), V.CONCEPT_SYNONYMS), lookup(s, V.CONCEPT_SYNONYMS), s)


def base_and_method(concept: Column) -> Column:
    """struct(base, method) by suffix; the two bare words of pressure cuffs and lines."""
    base, told = concept, F.lit("unspecified")
    for suffix, m in reversed(V.METHOD_SUFFIXES):
        hit = concept.endswith(suffix)
        base = F.when(hit, F.substring(concept, F.lit(1), F.length(concept) - len(suffix))).otherwise(base)
        told = F.when(hit, m).otherwise(told)
    for word, m in (("nibp", "noninvasive"), ("ibp", "invasive")):
        base, told = F.when(concept == word, "bp").otherwise(base), F.when(concept == word, m).otherwise(told)
    return F.struct(base.alias("base"), told.alias("method"))


def is_artefact(concept: Column) -> Column:
    return concept.isin(V.ARTEFACTS) | concept.rlike(V.ARTEFACT_PATTERN) | (F.length(concept) <= 1)


def display_name(label: Column, key: Column) -> Column:
    return last_segment(F.coalesce(F.nullif(label, F.lit("")), key))


def error_type(notes: Column, model: Column) -> Column:
    """The kind of a model's error, from what the experts noted."""
    told = F.lower(F.coalesce(notes, F.lit("")))

    def has(words: list[str]) -> Column:
        return F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(told, w)), True)

    kind = F.lit("concept naming granularity")
    kind = F.when(has(V.UNDECIDED_WORDS), "insufficient metadata to decide").otherwise(kind)
    kind = F.when(model == "UNKNOWN", "model abstained, experts assigned").otherwise(kind)
    for words, name in reversed(V.ERROR_WORDS):
        kind = F.when(has(words), name).otherwise(kind)
    return kind


#: Words that a card may not show: they would give the key away.
FORBIDDEN_IN_CARDS = ["itemid", "field_key"]
#: The card of a field in eleven slots, each with what stands for an empty one (fixed values).
CARD_TEMPLATE = [
    ("clinical field: ", "label", "unknown"),
    (" | abbreviation: ", "abbreviation", "none"),
    (" | source table: ", "src_table", "unknown"),
    (" | category: ", "category", "unspecified"),
    (" | data type: ", "dtype", "unknown"),
    (" | unit: ", "unit", "not recorded"),
    (" | typical range: p01 ", "p01", "na"),
    (", median ", "p50", "na"),
    (", p99 ", "p99", "na"),
    (" | observations per stay: ", "obs_per_key", "na"),
    (" | missing rate: ", "missing_rate", "na"),
]


def template_card(slots: dict[str, Column]) -> Column:
    """A field's card by the template; slots that are missing or empty are told as such."""
    parts = []
    for before, slot, empty in CARD_TEMPLATE:
        value = F.trim(slots[slot].cast("string")) if slot in slots else F.lit(None).cast("string")
        parts += [F.lit(before), F.coalesce(F.nullif(value, F.lit("")), F.lit(empty))]
    return F.concat(*parts)


def field_card(slots: dict[str, Column]) -> Column:
    """``name: value`` of all slots, in order; an empty one is ``unknown``."""
    told = [F.concat(F.lit(k + ": "), F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit("unknown"))) for k, v in slots.items()]
    return F.concat_ws("; ", *told)


def leaks_key(card: Column) -> Column:
    return F.greatest(*(F.lower(card).contains(w) for w in FORBIDDEN_IN_CARDS), F.lit(False))


def prompt(template: str, sources: Column, targets: Column) -> Column:
    """A template whose two marks are the lines of a batch of fields and of the concepts."""
    told = F.replace(F.lit(template), F.lit("{{source_columns}}"), F.array_join(sources, "\n"))
    return F.replace(told, F.lit("{{target_columns}}"), F.array_join(targets, "\n"))


def field_line(table: Column, label: Column, category: Column, unit: Column, kind: Column, median: Column) -> Column:
    """``table.label -- category …; unit …; type …; median …``, without empty parts."""
    told = {"category ": category, "unit ": unit, "type ": kind, "median ": median.cast("string")}
    parts = F.concat_ws("; ", *(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(k), v)) for k, v in told.items()))
    return F.concat_ws(" -- ", F.concat_ws(".", table, label), F.nullif(parts, F.lit("")))


def field_line_with_key(key: Column, table: Column, label: Column, category: Column, unit: Column, kind: Column, median: Column) -> Column:
    """As ``field_line``, with the raw key as its first attribute: for the memory check only."""
    plain = field_line(table, label, category, unit, kind, median)
    head = F.concat_ws(".", table, label)
    rest = F.substr(plain, F.length(head) + 5)
    return F.concat_ws("; ", F.concat(head, F.lit(" -- itemid "), key), F.nullif(rest, F.lit("")))


MAPPING_SHAPE = "mappings array<struct<source_column:string,target_mappings:array<struct<mapping:string>>>>"


def parse_mappings(text: Column) -> Column:
    """array<struct<source_column, targets>> from a completion's outermost JSON object.

    Targets that are empty or ``none`` are left out; text that is no such object has
    no mappings.
    """
    found = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), MAPPING_SHAPE)["mappings"]

    def told(x: Column) -> Column:
        names = F.transform(x["target_mappings"], lambda m: m["mapping"])
        kept = F.filter(names, lambda n: (F.coalesce(n, F.lit("")) != "") & (F.lower(n) != "none"))
        return F.struct(x["source_column"].alias("source_column"), F.coalesce(kept, F.array().cast("array<string>")).alias("targets"))

    return F.coalesce(F.transform(found, told), F.array().cast("array<struct<source_column:string,targets:array<string>>>"))


def catalogue_member(name: Column, members: Column) -> Column:
    """The name's last dotted part, if the catalogue has it."""
    plain = F.substring_index(name, ".", -1)
    return F.when(F.array_contains(members, plain), plain)


def normalize_answer(answer: Column) -> Column:
    """An annotator's answer; the ways to say unknown or unsure become one each."""
    plain = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return (
        F.when(plain.isin("unknown", "none", "n/a", "no match"), "UNKNOWN")
        .when(plain.isin("unsure", "?", "not sure"), "UNSURE")
        .otherwise(F.translate(plain, " -", "__"))
    )
