"""Expressions that Spark and the oracle's engine evaluate alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: dict[str, str | None]) -> Column:
    """The table's value for a key; null where it has none."""
    pairs = [F.lit(x) for k, v in table.items() if v is not None for x in (k, v)]
    return F.element_at(F.create_map(*pairs), key)


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule whose pattern, in either case, is found."""
    return F.coalesce(*(F.when(text.rlike(f"(?i){p}"), F.lit(v)) for p, v in rules))


def epoch_minutes(ts: Column) -> Column:
    return F.rint(F.unix_micros(ts) / 60e6).cast("long")


def try_number(text: Column) -> Column:
    """A finite double, or null; whole numbers are taken from it by ``floor``."""
    value = text.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def rounded(x: Column | str, digits: int) -> Column:
    """To ``digits`` decimals by scaling the double, halves away from zero, as SQL engines round.

    Spark's own ``round`` takes the shortest decimals of the double instead: 0.0070314999999999996
    is below a half for it, while the double, scaled to 7031.5, is one.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.round(x.cast("double") * scale) / scale


def years_apart(earlier: Column, later: Column) -> Column:
    """Year boundaries crossed."""
    return (F.year(later) - F.year(earlier)).cast("long")


def hash_tenth(key: Column) -> Column:
    """0 to 9 from the key's digest, the same in every engine with MD5."""
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") % 10


def split_of(key: Column) -> Column:
    tenth = hash_tenth(key)
    return F.when(tenth < 7, "train").when(tenth == 7, "val").otherwise("test")


def crc_split_of(key: Column) -> Column:
    """The field split by CRC-32 of the key's UTF-8 bytes."""
    tenth = F.crc32(key.cast("binary")) % 10
    return F.when(tenth < 7, "train").when(tenth == 7, "val").otherwise("test")


def last_segment(text: Column) -> Column:
    return F.substring_index(text, "|", -1)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
