"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
one's rows to the shared folder and hands what it reads from there to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import contamination, jaccard, mixing, quality, secrets
from fieldloom.llm.common import discard_since, stored, stored_paths, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limits."""
    found = quality.quality_rules(docs.select(*COLUMNS)).filter("kept")
    length = F.when(F.col("removed_words") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"n_chars": length, "text": F.col("clean_text")}).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, null last.

    Rows that share an id but not the text are documents of their own groups; repeated
    rows are one. Texts without words are in no group: their rows stay.
    """
    return jaccard.distinct_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no, or next to nothing, of the benchmark."""
    items = table(spark, sf_dir, "benchmark")
    found = contamination.decontaminate(docs.select(*COLUMNS), items, keep_text=True, unnamed=True)
    return found.filter(~F.col("contaminated")).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets cut out of their texts."""
    docs = docs.select(*COLUMNS)
    found = secrets.redact(secrets.find_secrets(docs, secrets.learn(docs)))
    length = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: see ``op2``; ``pieces`` are the training texts.

    A shard of the training set is its pieces, by ``slot`` and ``at``.
    """
    docs = docs.select(*COLUMNS)
    documents, segments = mixing.mix(docs)
    found = mixing.mixed_texts(docs, documents, segments)
    return found.select("doc_id", "source", "size", "source_size", "target", "taken", "pieces")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]

#: The near-duplicate and secret stages have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), stored_paths()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        # What a stage wrote for itself, and its predecessor's rows, are read no more.
        discard_since(before, docs)
    return docs
