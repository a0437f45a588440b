"""Field catalogues: one scan of the observations, however many figures.

Fields of few rows are dealt whole, a field to a task. Fields of many are counted out of
cells, each the rows of a field that share a stay, a value or a unit. Cells of two sets of
rows add up, so they are what is kept of part files that were profiled before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import rounded
from ..sources import scratch
from .jobs import PART, Job, dealt_profiles, parted
from .ordered import join_same, weighted_quantiles
from .relational import share

OBSERVATION = "stay_key bigint, field_key string, t_offset bigint, value_num double, value_uom string, src_table string"
FIELD = ["field_key", "src_table"]
#: What a cell counts, by the bits of the columns that it leaves out.
KINDS = {0b011: "stay", 0b101: "value", 0b110: "unit"}
PARTS = ["stay_key", "value_num", "value_uom"]
QUANTILES = {"p01": (1, 100), "p50": (1, 2), "p99": (99, 100)}


def dtype_of(numeric_rate: Column) -> Column:
    return F.when(numeric_rate >= 0.95, "numeric").when(numeric_rate <= 0.05, "categorical").otherwise("mixed")


def field_cells(observations: DataFrame) -> DataFrame:
    """(field_key, src_table, kind, stay_key, value_num, value_uom, n) by grouping sets over one scan.

    Each row adds to one cell of its stay, its value and its unit; rows are counted on the
    map side, so that a field of 10⁹ rows is its distinct values by the time it is shuffled.
    """
    sets = [[*FIELD, p] for p in PARTS]
    counted = observations.groupingSets(sets, *FIELD, *PARTS).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_left_out"))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("_left_out").cast("int"))
    return counted.select(*FIELD, kind.alias("kind"), *PARTS, "n")


def merged_cells(cells: DataFrame) -> DataFrame:
    """Cells of several sets of rows as those of all of them."""
    return cells.groupBy(*FIELD, "kind", *PARTS).agg(F.sum("n").alias("n"))


def _modal(of: Column) -> Column:
    return F.min(F.when(of, F.struct((-F.col("n")).alias("n"), F.col("value_uom").alias("unit"))))["unit"].alias("unit_observed")


def catalog_of(cells: DataFrame, stays: DataFrame | None = None) -> DataFrame:
    """The catalogue of stored cells; ``stays`` is one row (_stays), else all stays of the cells."""
    of = {k: F.col("kind") == k for k in KINDS.values()}
    told = {k: c & F.col(p).isNotNull() for (k, c), p in zip(of.items(), PARTS, strict=True)}
    if stays is None:
        stays = cells.filter(told["stay"]).agg(F.countDistinct("stay_key").alias("_stays"))
    counted = cells.groupBy(*FIELD).agg(
        F.sum(F.when(of["value"], F.col("n")).otherwise(0)).alias("n_rows"),
        F.count_if(told["stay"]).alias("n_keys"),
        F.sum(F.when(told["value"], F.col("n")).otherwise(0)).alias("n_numeric"),
        F.sum(F.when(told["unit"], F.col("n")).otherwise(0)).alias("n_with_uom"),
        _modal(told["unit"]),
    )
    found = weighted_quantiles(cells.filter(told["value"]), FIELD, "value_num", "n", QUANTILES)
    return _rates(join_same(counted, found, FIELD, "left"), stays)


def _catalog_of_whole(rows: DataFrame, units: DataFrame, stays: DataFrame) -> DataFrame:
    """The catalogue of fields each of which a task can hold; ``units`` count their rows by unit."""
    found = dealt_profiles(rows, "field_key", [Job("catalogue", tuple(FIELD), "value_num", "stay_key")], rows.count() // PART + 1)
    keys = [F.get("keys", F.lit(i)).alias(k) for i, k in enumerate(FIELD)]
    found = found.select(*keys, F.col("n").alias("n_rows"), F.col("n_entities").alias("n_keys"), "n_numeric", *QUANTILES)
    named = F.col("value_uom").isNotNull()
    counted = units.groupBy(*FIELD).agg(F.sum(F.when(named, F.col("n")).otherwise(0)).alias("n_with_uom"), _modal(named))
    return _rates(join_same(found, counted, FIELD), stays)


def _rates(counted: DataFrame, stays: DataFrame) -> DataFrame:
    numeric = F.col("n_numeric") / F.col("n_rows")
    return (
        counted.crossJoin(F.broadcast(stays))  # one row
        .withColumns(
            {q: rounded(q, 4) for q in QUANTILES}
            | {
                "unit_recovery_rate": share(F.col("n_with_uom"), F.col("n_rows")),
                "numeric_rate": rounded(numeric, 4),
                "coverage": share(F.col("n_keys"), F.col("_stays")),
                "missing_rate": rounded(1 - F.col("n_keys") / F.col("_stays"), 4),
                "obs_per_key": rounded(F.col("n_rows") / F.col("n_keys"), 2),
                "dtype_inferred": dtype_of(numeric),
            }
        )
        .drop("_stays")
    )


def field_catalog(observations: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """Counts, distinct stays, modal unit, quantiles, rates and type of each field.

    ``cohort`` (stay_key) restricts the observations by a semi join and gives the
    denominator of coverage; without it, the observations' own stays do. The observations
    are read once, and stored; what follows reads the stored columns. A field key of at most
    a piece of rows is sent whole, each row once; of others, cells are counted where rows are.
    """
    stays = None
    if cohort is not None:
        observations = observations.join(cohort.select("stay_key").distinct(), "stay_key", "left_semi")
        stays = cohort.agg(F.countDistinct("stay_key").alias("_stays"))
    value = (F.col("value_num") + F.lit(0.0)).alias("value_num")  # one zero, as in cells
    rows = scratch.stored(observations.select(*FIELD, "stay_key", value, "value_uom"), "observations")
    if stays is None:
        stays = rows.agg(F.countDistinct("stay_key").alias("_stays"))
    units = scratch.stored(rows.groupBy(*FIELD, "value_uom").agg(F.count(F.lit(1)).alias("n")), "units")
    few, many = parted(rows, "field_key", "frequent", units)
    # Units of frequent fields find no other field in the join.
    found = _catalog_of_whole(few, units, stays)
    if many is None:
        return found
    return found.unionByName(catalog_of(scratch.stored(field_cells(many), "cells"), stays))


def with_dictionary(catalog: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Labels of a dictionary for the catalogue's fields: few rows meet few rows."""
    return catalog.join(dictionary, "field_key", "left")


def unit_recovery(catalogs: DataFrame, group: list[str]) -> DataFrame:
    return catalogs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_fields"),
        F.sum("n_rows").alias("n_rows"),
        F.count_if(F.col("unit_observed").isNull()).alias("fields_without_unit"),
        rounded(F.sum("n_with_uom") / F.sum("n_rows"), 4).alias("row_recovery"),
        rounded(F.avg("unit_recovery_rate"), 4).alias("mean_field_recovery"),
    )
