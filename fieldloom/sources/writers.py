"""Sinks: parquet or CSV by suffix, resumable steps, counted on the way out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def write(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes by the path's suffix and returns the rows, counted in the same pass."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if path.endswith(".csv"):
        # Quotes are doubled, as the readers take them.
        counted.write.mode(mode).option("escape", '"').csv(path, header=True)
    else:
        counted.write.mode(mode).option("compression", "zstd").parquet(path)
    return seen.get["rows"]


def step(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What is at ``path`` if a finished write is there, else made and written."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        write(make(), path)
    return spark.read.parquet(path)


def run_jobs(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]], folder: str) -> DataFrame:
    """(name, rows, seconds, error): each job by itself; one that fails stops no other."""
    done = []
    for name, make in jobs.items():
        began = time.time()
        try:
            done.append((name, write(make(), f"{folder}/{name}"), time.time() - began, None))
        except Exception as e:
            done.append((name, None, time.time() - began, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(done, "name string, rows long, seconds double, error string")


def append_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and of each key that is not among theirs one new row; nulls in keys are equal."""
    from ..operators.ordered import join_same

    late = join_same(new, old.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return old.unionByName(late, allowMissingColumns=True)
