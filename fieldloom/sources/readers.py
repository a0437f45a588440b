"""Sources: everything arrives as strings or columns, and is typed on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The byte-order mark of UTF-8 text.
MARK = "\ufeff"


def csv_strings(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, all columns strings; a byte-order mark is no part of a name."""
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding=encoding, quote='"', escape='"')
    return df.toDF(*(c.removeprefix(MARK) for c in df.columns))


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """The file inventory: five tab-separated columns without a header."""
    return spark.read.schema("dataset string, relpath string, bytes long, rows long, cols long").csv(path, sep="\t")


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """One file, a folder of part files, or a glob."""
    return spark.read.parquet(path)


def describe(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, column_type) of a relation, without reading it."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, column_type string")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def whole_texts(spark: SparkSession, path: str, pattern: str = "*.sql") -> DataFrame:
    """(src_file, text) of all files under a folder."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return texts.select(F.input_file_name().alias("src_file"), F.col("value").alias("text"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, column_name) of CSV files; names may be quoted, with commas or line breaks."""
    from .footers import csv_records, header_names

    return csv_records(spark, path).select("file", F.posexplode(header_names("header")).alias("ordinal", "column_name"))


def csv_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows, cols) of CSV files: records but for the header, and the header's columns.

    Records are counted where the files lie, split; a quoted line break is no new row.
    """
    from .footers import csv_records, header_names

    found = csv_records(spark, path)
    return found.select("file", "bytes", (F.col("records") - 1).alias("rows"), F.size(header_names("header")).cast("long").alias("cols"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def if_there(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The union of those parquet sources that exist; none if none does."""
    found = [spark.read.parquet(p) for p in paths if exists(spark, p)]
    out = None
    for df in found:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def keyed_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector as doubles): a matrix with its key list, row by row."""
    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
