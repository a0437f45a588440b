"""Scratch files of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .writers import write

#: Paths of this process that are not deleted yet, with their session.
_paths: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset, a folder of this machine in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path of the shared folder, deleted at the end of the driver's process."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}/{label}"
    _paths[path.rsplit("/", 1)[0]] = spark
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the plan behind it is cut, and is run once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def temp_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, and known to SQL by ``name`` until the session ends.

    A lost executor costs a read of the files; a table of the same name is replaced.
    """
    path = scratch_path(df.sparkSession, name)
    write(df, path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.createOrReplaceTempView(name)
    return found


@atexit.register
def clear() -> None:
    """Deletes all scratch files; those of a stopped session stay."""
    while _paths:
        path, spark = _paths.popitem()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone before us
            return
