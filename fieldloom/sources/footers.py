"""Counts without data: parquet footers, and records of CSV files of any size."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .readers import MARK


def parquet_counts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: ``rows``, and the values of each column that are not null, from the footers.

    Spark answers counts of its own parquet source out of the row groups' statistics where
    it may push aggregates down; that is asked for in a session beside the caller's, whose
    settings stay as they are. No data page is read.
    """
    side = _pushing(spark)
    counted = side.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in columns))
    return spark.createDataFrame([tuple(counted.first())], ", ".join(f"`{c}` long" for c in ["rows", *columns]))


def _pushing(spark: SparkSession) -> SparkSession:
    side = spark.newSession()
    old = [s for s in side.conf.get("spark.sql.sources.useV1SourceList").split(",") if s != "parquet"]
    side.conf.set("spark.sql.sources.useV1SourceList", ",".join(old))
    side.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return side


def reads_footers_only(spark: SparkSession, path: str, columns: list[str]) -> bool:
    """Whether the plan of ``parquet_counts`` pushes its counts into the scan."""
    plan = _pushing(spark).read.parquet(path).agg(F.count(F.lit(1)), *(F.count(c) for c in columns))
    return "PushedAggregation: [COUNT" in plan._jdf.queryExecution().executedPlan().toString()


BLOCK = "file string, bytes long, block long, even long, odd long, parity int, header string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a file: records that end in it, if it begins outside quotes or inside.

    A line ends a record if an even number of quotes stands before its end. A blank line
    outside quotes is no record. The first record of a file is its header.
    """
    done: dict[tuple[str, int, int], list] = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("file", "bytes", "block", "value"))
        for file, size, block, line in zip(*columns, strict=True):
            now = done.setdefault((file, size, block), [0, 0, 0, [], False])
            began, quotes = now[2], line.count('"') & 1
            now[2] ^= quotes
            blank = not line.strip() and not quotes
            if not (blank and began == 0):
                now[0] += now[2] == 0
            if not (blank and began == 1):
                now[1] += now[2] == 1
            if block == 0 and not now[4]:
                now[3].append(line)
                now[4] = now[2] == 0
    rows = [(*k, even, odd, parity, "\n".join(head) if k[2] == 0 else None) for k, (even, odd, parity, head, _) in done.items()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])


@F.pandas_udf(ArrayType(StringType()))
def header_names(header: pd.Series) -> pd.Series:
    """Names of a CSV header, which may be quoted and hold commas, quotes or line breaks."""
    return pd.Series([next(csv.reader(h.removeprefix(MARK).splitlines(True)), []) for h in header])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, records, header): a quoted line break is inside its record.

    Files are split. Each block tells its records for both ways that it may begin; which
    one holds is the parity of the quotes of the blocks before it.
    """
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_size", "bytes"), ("file_block_start", "block"))]
    blocks = spark.read.text(path).select(*meta, "value").mapInArrow(_blocks, BLOCK)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1
    placed = blocks.withColumn("ends", F.when(inside, F.col("odd")).otherwise(F.col("even")))
    return placed.groupBy("file", "bytes").agg(F.sum("ends").alias("records"), F.max("header").alias("header"))
