"""Unit algebra as column expressions: normalise, relate, convert, read from names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabulary as V
from .portable import first_match, lookup

FACTORS = {f"{a}>{b}": f for a, b, f, *_ in V.UNIT_CONVERSIONS if f is not None}
OFFSETS = {f"{a}>{b}": o for a, b, f, o, *_ in V.UNIT_CONVERSIONS if f is not None}
CONDITIONAL = [f"{a}>{b}" for a, b, f, *_ in V.UNIT_CONVERSIONS if f is None]


def normalize_unit(unit: Column) -> Column:
    """The canonical unit of any spelling; null for none. Unknown ones stay, trimmed."""
    tidy = F.lower(F.trim(F.regexp_replace(unit, r"\s+", " ")))
    tight = F.replace(tidy, F.lit(" "))
    none = [k for k, v in V.UNIT_ALIASES.items() if v is None]
    known = [k for k, v in V.UNIT_ALIASES.items() if v is not None]
    return (
        F.when(unit.isNull() | tidy.isin(none), F.lit(None).cast("string"))
        .when(tidy.isin(known), lookup(tidy, V.UNIT_ALIASES))
        .when(tight.isin(none), F.lit(None).cast("string"))
        .when(tight.isin(known), lookup(tight, V.UNIT_ALIASES))
        .otherwise(F.trim(unit))
    )


def dimension(unit: Column) -> Column:
    return lookup(unit, V.UNIT_DIMENSIONS)


def _way(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(">"), b)


def _number(way: Column, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), way)


def convert(value: Column, source: Column, target: Column) -> Column:
    """(value + offset) · factor in the table's own direction; else null."""
    a, b = normalize_unit(source), normalize_unit(target)
    way = _way(a, b)
    return F.when(a == b, value).otherwise((value + _number(way, OFFSETS)) * _number(way, FACTORS))


def relation(a: Column, b: Column) -> Column:
    """same, convertible, unknown or conflict, of two normalised units; either direction."""
    there, back = _way(a, b), _way(b, a)
    known = list(FACTORS)
    return (
        F.when(a.isNull() | b.isNull(), "unknown")
        .when(a == b, "same")
        .when(there.isin(known), "convertible")
        .when(there.isin(CONDITIONAL), "unknown")
        .when(back.isin(known), "convertible")
        .when(back.isin(CONDITIONAL), "unknown")
        .when(dimension(a) != dimension(b), "conflict")
        .otherwise("unknown")
    )


def unit_from_name(name: Column) -> Column:
    return first_match(name, V.NAME_UNITS)


def effective_unit(unit: Column, name: Column) -> Column:
    """struct(source, unit): measured, else from the name, else missing."""
    measured, told = normalize_unit(unit), unit_from_name(name)
    source = F.when(measured.isNotNull(), "measured").when(told.isNotNull(), "from_name").otherwise("missing")
    return F.struct(source.alias("source"), F.coalesce(measured, told).alias("unit"))


#: Columns of a unit table; where its path may be configured; rows that may be broadcast.
TABLE_SCHEMA = "from_unit string, to_unit string, factor string, offset string, dimension string, condition string, source string"
TABLE_SETTING = "fieldloom.unitTable"
MOST_CONVERSIONS = 100_000


def load_table(spark: SparkSession, path: str | None = None, fallbacks: tuple[str, ...] = ()) -> DataFrame:
    """The users' own unit table: of ``path``, else the session's setting, else the first fallback there."""
    from ..sources.readers import csv_strings, exists

    path = path or spark.conf.get(TABLE_SETTING, None) or next((p for p in fallbacks if exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"no unit table: give a path or set {TABLE_SETTING}")
    rows = csv_strings(spark, path)
    names = [x.split()[0] for x in TABLE_SCHEMA.split(", ")]
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names))


def with_table(df: DataFrame, table: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Adds ``relation`` and ``converted`` of units ``a`` and ``b`` by a table of conversions.

    Of repeated conversions the last by its text counts; either direction relates, the
    table's own converts; a dimension that is not known comes from the first row by
    text whose ``from_unit`` it is.
    """
    ways = table.select(normalize_unit(F.col("from_unit")).alias("_a"), normalize_unit(F.col("to_unit")).alias("_b"), "factor", "offset", "dimension", "source")
    ways = ways.filter("_a IS NOT NULL AND _b IS NOT NULL")
    blank = F.trim(F.coalesce("factor", F.lit(""))) == ""
    rule = F.struct("source", blank.alias("open"), F.expr("try_cast(factor AS double)").alias("factor"), F.coalesce(F.expr("try_cast(offset AS double)"), F.lit(0.0)).alias("offset"))
    rules = ways.groupBy("_a", "_b").agg(F.max(rule).alias("r"))
    told = ways.filter(F.coalesce("dimension", F.lit("")) != "").groupBy("_a").agg(F.min("dimension").alias("d"))
    if ways.limit(MOST_CONVERSIONS + 1).count() <= MOST_CONVERSIONS:
        rules, told = F.broadcast(rules), F.broadcast(told)
    out = df.withColumns({"_a": normalize_unit(F.col(a)), "_b": normalize_unit(F.col(b))})
    out = out.join(rules.withColumnRenamed("r", "_there"), ["_a", "_b"], "left")
    out = out.join(rules.select(F.col("_a").alias("_b"), F.col("_b").alias("_a"), F.col("r").alias("_back")), ["_a", "_b"], "left")
    for side in ("_a", "_b"):
        out = out.join(told.select(F.col("_a").alias(side), F.col("d").alias("_d" + side)), side, "left")
        out = out.withColumn("_d" + side, F.coalesce(dimension(F.col(side)), F.col("_d" + side)))
    found = F.coalesce("_there", "_back")
    relation_ = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown")
        .when(F.col("_a") == F.col("_b"), "same")
        .when(found["open"], "unknown")
        .when(found.isNotNull(), "convertible")
        .when(F.col("_d_a") != F.col("_d_b"), "conflict")
        .otherwise("unknown")
    )
    there = F.col("_there")
    converted = F.when(F.col("_a") == F.col("_b"), F.col(value)).otherwise((F.col(value) + there["offset"]) * there["factor"])
    return out.withColumns({"relation": relation_, "converted": converted}).drop("_a", "_b", "_there", "_back", "_d_a", "_d_b")
