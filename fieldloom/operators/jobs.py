"""Many profiles of one table.

A job names key columns, a value and an entity. Jobs are put together by the one of their key
columns that has the most values: rows are dealt by it once for all of them, and become cells
only behind that shuffle, where each group of every job is whole. Keys of so many rows that
they would be too much for a task are counted out of additive cells instead; their entities
are counted where rows are dealt by entity, so that no cell of a key and an entity is sent.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import rounded
from ..sources import scratch
from . import ordered as O
from .ordered import join_same, weighted_quantiles
from .relational import top_per_key


class Job(NamedTuple):
    """Profiles of ``value`` and ``entity`` by ``keys``, over the rows where the SQL of ``where`` holds; ``limit`` is a top list."""

    name: str
    keys: tuple[str, ...]
    value: str
    entity: str
    where: str | None = None
    limit: int | None = None


GROUP = ["job", "keys"]
QUANTILES = {"p01": (1, 100), "p50": (1, 2), "p99": (99, 100)}


#: Rows of a dealt part, whose cells are sorted in one task.
PART = 100_000


def _keys(job: Job) -> Column:
    return F.array(*(F.col(k).cast("string") for k in job.keys))


def _value(job: Job) -> Column:
    return F.expr(f"try_cast(`{job.value}` AS double)")


def _taken(rows: DataFrame, jobs: list[Job]) -> DataFrame:
    """The columns that some jobs read, and which rows each job takes."""
    used = dict.fromkeys(c for j in jobs for c in (*j.keys, j.value, j.entity))
    return rows.select(*used, *(F.coalesce(F.expr(j.where), F.lit(False)).alias(f"_takes_{j.name}") for j in jobs if j.where is not None))


def _made(job: Job, cell: Column) -> Column:
    return cell if job.where is None else F.when(F.col(f"_takes_{job.name}"), cell)


def parted(rows: DataFrame, column: str, label: str, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose value of a column has at most PIECE rows, and the others, if there are any; ``cells`` of the rows, of ``n`` each, tell their number."""
    n = F.count(F.lit(1)) if cells is None else F.sum("n")
    many = (rows if cells is None else cells).groupBy(column).agg(n.alias("_n")).filter(F.col("_n") > O.PIECE).select(column)
    many = scratch.stored(many, label)
    if many.isEmpty():
        return rows, None
    few = F.broadcast(many.select(F.col(column).alias("_many")))  # fewer than the pieces of the rows
    same = F.col(column).eqNullSafe(F.col("_many"))
    return rows.join(few, same, "left_anti"), rows.join(few, same, "left_semi")


def dealt_profiles(rows: DataFrame, column: str, jobs: list[Job], parts: int) -> DataFrame:
    """Profiles of keys that are whole in the part of their value of ``column``."""
    others = list(dict.fromkeys(k for j in jobs for k in j.keys if k != column))
    kinds = dict(rows.dtypes)
    entity = kinds[jobs[0].entity] if len({kinds[j.entity] for j in jobs}) == 1 else "string"

    def cell(i: int, job: Job, is_value: bool) -> Column:
        keys = [F.when(F.lit(k in job.keys), F.col(k)).alias(f"_key_{k}") for k in others]
        value = _value(job) if is_value else F.lit(None).cast("double")
        told = F.lit(None).cast(entity) if is_value else F.col(job.entity).cast(entity)
        return _made(job, F.struct(F.lit(i).alias("_job"), *keys, F.lit(is_value).alias("_is_value"), value.alias("_value"), told.alias("_entity")))

    dealt = rows.repartition(parts, column)
    cells = F.explode(F.array(*(cell(i, j, v) for i, j in enumerate(jobs) for v in (True, False)))).alias("c")
    cells = dealt.select(F.col(column).alias("_by"), cells).filter("c IS NOT NULL").select("_by", "c.*")
    group = ["_by", "_job", *(f"_key_{k}" for k in others)]
    whole = Window.partitionBy(*group)
    order = whole.orderBy("_is_value", "_value", "_entity")
    numeric = F.col("_value").isNotNull().cast("long")
    placed = cells.withColumns({
        "_up_to": F.sum(numeric).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_new": ~F.col("_is_value") & F.col("_entity").isNotNull() & ~F.coalesce(F.lag("_entity").over(order) == F.col("_entity"), F.lit(False)),
    }).withColumn("_total", F.sum(numeric).over(whole))
    found = placed.groupBy(*group).agg(
        F.count_if("_is_value").alias("n"),
        F.count_if("_new").alias("n_entities"),
        F.count("_value").alias("n_numeric"),
        *(F.min(F.when(F.col("_up_to") * b >= F.col("_total") * a, F.col("_value"))).alias(q) for q, (a, b) in QUANTILES.items()),
    )
    name = F.get(F.array(*(F.lit(j.name) for j in jobs)), F.col("_job"))
    keys = [F.array(*(F.col("_by" if k == column else f"_key_{k}").cast("string") for k in j.keys)) for j in jobs]
    chosen = keys[0]
    for i, k in enumerate(keys[1:], 1):
        chosen = F.when(F.col("_job") == i, k).otherwise(chosen)
    return found.select(name.alias("job"), chosen.alias("keys"), "n", "n_entities", "n_numeric", *QUANTILES)


def _entities(rows: DataFrame, jobs: list[Job], parts: int) -> DataFrame:
    """(job, keys, n_entities): an entity's keys are told apart where all its rows are."""

    def distinct(some: DataFrame, mine: list[Job]) -> DataFrame:
        cells = F.explode(F.array(*(_made(j, F.struct(F.lit(j.name).alias("job"), _keys(j).alias("keys"))) for j in mine))).alias("c")
        return some.select(mine[0].entity, cells).filter("c IS NOT NULL").groupBy(mine[0].entity, "c").agg(F.lit(1)).select("c.*")

    found = None
    for entity in dict.fromkeys(j.entity for j in jobs):
        mine = [j for j in jobs if j.entity == entity]
        told = _taken_of(rows, mine).filter(F.col(entity).isNotNull())
        few, many = parted(told, entity, "entities")
        one = distinct(few.repartition(parts, entity), mine).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_entities"))
        found = one if found is None else found.unionByName(one)
        if many is not None:
            found = found.unionByName(distinct(many, mine).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_entities")))
    return found.groupBy(*GROUP).agg(F.sum("n_entities").alias("n_entities"))


def _taken_of(rows: DataFrame, jobs: list[Job]) -> DataFrame:
    """The columns that tell keys and entities of some jobs, without values."""
    used = dict.fromkeys(c for j in jobs for c in (*j.keys, j.entity))
    return rows.select(*used, *(f"_takes_{j.name}" for j in jobs if j.where is not None))


def _counted(rows: DataFrame, jobs: list[Job], parts: int) -> DataFrame:
    """Profiles of keys of many rows, out of cells (job, keys, value, n)."""
    cells = F.explode(F.array(*(_made(j, F.struct(F.lit(j.name).alias("job"), _keys(j).alias("keys"), _value(j).alias("value"))) for j in jobs))).alias("c")
    cells = rows.select(cells).filter("c IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c.*", "n")
    cells = scratch.stored(cells, "profiles")
    counted = cells.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_numeric"))
    out = join_same(counted, weighted_quantiles(cells, GROUP, "value", "n", QUANTILES), GROUP, "left")
    out = join_same(out, _entities(rows, jobs, parts), GROUP, "left")
    return out.select(*GROUP, "n", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "n_numeric", *QUANTILES)


def profiles(rows: DataFrame, jobs: list[Job]) -> DataFrame:
    """(job, keys, n, n_entities, n_numeric, n_other, p01, p50, p99) of all jobs.

    ``keys`` are the key columns as strings, nulls kept. Values that are no number count
    as ``n_other``. Of a job with a limit the most frequent keys stay, ties by the keys.
    """
    columns = list(dict.fromkeys(k for j in jobs for k in j.keys))
    told = rows.agg(F.count(F.lit(1)).alias("_rows"), *(F.approx_count_distinct(k).alias(k) for k in columns)).first()
    parts = told["_rows"] // PART + 1
    sets: dict[str, list[Job]] = {}
    for job in jobs:
        sets.setdefault(max(job.keys, key=lambda k: told[k]), []).append(job)
    out = None
    for column, some in sets.items():
        few, many = parted(_taken(rows, some), column, "frequent")
        found = dealt_profiles(few, column, some, parts)
        if many is not None:
            found = found.unionByName(_counted(many, some, parts))
        out = found if out is None else out.unionByName(found)
    out = out.withColumn("n_other", F.col("n") - F.col("n_numeric")).select(*GROUP, "n", "n_entities", "n_numeric", "n_other", *QUANTILES)
    limits = {j.name: j.limit for j in jobs if j.limit is not None}
    if not limits:
        return out
    out = scratch.stored(out, "profiled")
    kept = out.filter(~F.col("job").isin(list(limits)))
    for name, k in limits.items():
        kept = kept.unionByName(top_per_key(out.filter(F.col("job") == name), ["job"], [F.desc("n"), F.col("keys")], k).drop("rank"))
    return kept


def filled_cells(rows: DataFrame, columns: list[str], entity: str) -> DataFrame:
    """One row: rows, distinct entities and, for each column of a wide table, how many cells are filled."""
    filled = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"nn_{c}") for c in columns]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(entity).alias("n_entities"), *filled)


def share_of_job(profiled: DataFrame) -> DataFrame:
    """Adds each key's share of its job's rows; jobs are few, keys are many."""
    whole = profiled.groupBy("job").agg(F.sum("n").alias("_all"))
    return profiled.join(F.broadcast(whole), "job").withColumn("share", rounded(F.col("n") / F.col("_all"), 6)).drop("_all")
