"""The queries of this subpackage over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, contamination, jaccard, lines, lm, mixing, negatives, quality, repair, secrets, tokens, toxicity, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.quality_rules(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "removed_words",
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken(*mixing.mix(docs)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.learn(docs))

    def number(kind: str):  # noqa: ANN202
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.joined("secrets", base_only=True), 256).alias("base_sha256"),
        secrets.joined("secrets", base_only=False).alias("spans"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending"
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), unnamed=True).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    where = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(docs, where, public_tokenizers.PATTERN)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; the target are those that are labelled of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = (
        table(spark, sf_dir, "labels")
        .filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("is_target"))
        .filter("is_target")
    )
    return lm.cross_entropy_of_corpus(docs, good)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(*columns).unionByName(extra)
    # Conversations come as records of all layouts, whose fingerprints lead back to their turns.
    records = chat.outlines(chat.as_turns(rows).select("conv_id", "turns"))
    return chat.digests(chat.read_back(chat.render(chat.outlined_turns(records))))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.summary(warc.derivatives(warc.responses(pages)))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come to the index in two loads, as they do to a corpus that grows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = lines.LineIndex(spark)
    load = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0))
    for k in (0, 1):
        index.insert(docs.filter(load == k))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    return index.deduplicated(docs, min_docs=3).select("doc_id", "n_lines", "n_dropped", kept)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), anchors=F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}
