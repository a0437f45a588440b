"""Shared helpers of the text operators: words, scratch tables and arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` leaves it out.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; null has none."""
    kept = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(kept == "", F.array().cast("array<string>")).otherwise(F.split(kept, SPACE_RUN))


def word_count(text: Column) -> Column:
    kept = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(kept == "", F.lit(0)).otherwise(F.size(F.split(kept, SPACE_RUN))).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, one is made on this machine, if the executors are on it, too.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Tables of this process that are not deleted yet, with their session.
_tables: dict[str, SparkSession] = {}
#: Rows of a key from which it is hot, whatever the total; and keys that may be hot.
HOT_ROWS, HOT_KEYS = 64, 10_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the plan behind it is cut.

    A lost executor then costs a read of these files, not the work before them. The
    files stay until ``discard``, or the end of the driver's process.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _tables[path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        _delete(df._stored_path)


def stored_paths() -> set[str]:
    return set(_tables)


def discard_since(before: set[str], *kept: DataFrame) -> None:
    """Deletes the tables that were stored after ``before`` was taken, but for some."""
    for path in set(_tables) - before - {df._stored_path for df in kept}:
        _delete(path)


def _delete(path: str) -> None:
    spark = _tables.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_tables):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - the session's JVM has ended before
            return


def hot_join(left: DataFrame, right: DataFrame, key: str | list[str], total: int, how: str = "inner", least: int = 0) -> DataFrame:
    """``left`` joined with ``right``, which has a row for each key and its rows ``n`` in ``left``.

    Keys of more than a ten-thousandth of all ``total`` rows are joined by broadcast,
    where the rows are: there are about HOT_KEYS of them at most. No key that is
    shuffled then fills a task. ``n`` stays in the result; all are above ``least``.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    if total <= bound:
        return left.join(right, key, how)
    hot = right.filter(F.col("n") > bound)
    if least >= bound and how == "inner":
        return left.join(F.broadcast(hot), key)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(right.filter(F.col("n") <= bound), key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[str]:
    """Arrow strings as Python strings; null is the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """Arrow strings as UTF-8 bytes, without decoding; null is the empty text."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""
