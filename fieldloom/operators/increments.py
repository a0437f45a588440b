"""A catalogue that grows with its folder: new part files are profiled alone.

State is two tables under one folder: ``manifest`` names the part files that are counted,
``cells`` holds the additive cells (see ``catalog``) of each batch of them. A batch is
written cells first and manifest last, under one name: cells of a batch that no manifest
names belong to a run that failed, and are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from .catalog import catalog_of, field_cells, merged_cells

MANIFEST = "path string, bytes long, modified timestamp, batch int"


def part_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified) of the part files under a folder, without reading them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return listed.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def counted_files(spark: SparkSession, state: str) -> DataFrame:
    if not readers.exists(spark, f"{state}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{state}/manifest")


def count_new_parts(spark: SparkSession, folder: str, state: str, observe: Callable[[DataFrame], DataFrame]) -> int:
    """Adds the cells of the part files that are not counted yet; how many those are.

    ``observe`` makes observations out of the files' rows. A file that was counted and has
    changed since is an error: what it added cannot be taken back from the cells.
    """
    there, known = part_files(spark, folder), counted_files(spark, state)
    old = known.select("path", F.col("bytes").alias("_bytes"), F.col("modified").alias("_modified"), "batch")
    joined = there.join(old, "path", "left")
    changed = joined.filter(F.col("batch").isNotNull() & ((F.col("bytes") != F.col("_bytes")) | (F.col("modified") != F.col("_modified"))))
    if row := changed.select("path").first():
        raise ValueError(f"{row['path']} has changed since it was counted")
    new = joined.filter(F.col("batch").isNull()).select("path", "bytes", "modified").collect()  # names of new files
    if not new:
        return 0
    batch = (known.agg(F.max("batch")).first()[0] or 0) + 1
    cells = field_cells(observe(spark.read.parquet(*(r["path"] for r in new))))
    cells.write.mode("overwrite").parquet(f"{state}/cells/batch={batch}")
    rows = [(r["path"], r["bytes"], r["modified"], batch) for r in new]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{state}/manifest")
    return len(new)


def catalog_so_far(spark: SparkSession, state: str) -> DataFrame:
    """The catalogue of all counted files, from the cells alone."""
    batches = [r["batch"] for r in counted_files(spark, state).select("batch").distinct().collect()]
    cells = spark.read.parquet(*(f"{state}/cells/batch={b}" for b in sorted(batches)))
    return catalog_of(merged_cells(cells))
