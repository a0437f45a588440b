"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, digits as 0, white space runs as one blank) and
hashed. Per host, the distinct documents that hold a line are counted; a line in
more than ``min_docs`` documents and more than ``share`` of the host's documents is
above the limits and is removed from all documents of the host but its holder, the
one with the smallest id, so that no wording is lost altogether. A document that
keeps less than ``keep_share`` of its words is depleted and rejected.

Exact copies on a host are one document: their number alone never removes a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hot_join, stored, words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def _content_hash(text: Column) -> Column:
    return F.xxhash64(text)


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the word, symbol, line and repetition counts of each whole text.

    A null text has no words. Repeated words are those inside any 8-word window that
    the text has twice or more; windows are compared by 64-bit hashes within a text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", words(F.col(text)))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
            "_lines": lines,
            "_hashes": F.when(F.size("_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))),
                )
            ),
        }
    )
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            # Only texts with a repeated window go through the sort.
            "_sorted": F.when(
                F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
                F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        }
    )
    df = df.withColumn(
        "_starts",
        F.sort_array(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k - 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get("_sorted", k + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    steps = F.transform(
        "_starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - p, F.lit(WINDOW)))
    )
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long")
    # A partition's number is not deterministic to the optimizer: filters on the counts
    # stay above this projection, for below it each would repeat all expressions.
    df = df.withColumns({"n_repeat_words": repeated, "_partition": F.spark_partition_id()})
    return df.drop("_words", "_lines", "_hashes", "_sorted", "_starts")


def normalised(text: Column) -> Column:
    """A text or a line as lines are compared, but for blanks at their ends."""
    plain = F.regexp_replace(F.lower(text), "[0-9]", "0")
    return F.regexp_replace(plain, "[\\x20\\x09\\x0B-\\x0D]+", " ")


def host_lines(docs: DataFrame, text: str, host: str, key: str) -> DataFrame:
    """One row for each host, distinct document content and distinct normalised line; ``at`` are its places."""
    plain = normalised(F.coalesce(F.col("_text"), F.lit("")))
    placed = F.transform(F.split(plain, "\n"), lambda x, i: F.struct(F.btrim(x).alias("x"), i.alias("at")))
    lines = F.filter(placed, lambda s: s["x"] != "")
    found = F.transform(
        lines, lambda s: F.struct(F.xxhash64(s["x"]).alias("line"), F.size(F.split(s["x"], " ")).alias("line_words"), s["at"].alias("at"))
    )
    rows = docs.select(
        F.coalesce(F.col(host), F.lit("")).alias("host"),
        _content_hash(F.coalesce(F.col(text), F.lit(""))).alias("content"),
        F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("first_id"),
        F.col(text).alias("_text"),
    )
    # The text is hashed before its lines become rows: once, and not for each of them.
    rows = rows.select("host", "content", "first_id", F.posexplode(found).alias("place", "found")).select("host", "content", "first_id", "place", "found.*")
    # The content hash in the key spreads a hot line or host over all partitions.
    return (
        rows.repartition("host", "line", "content")
        .groupBy("host", "line", "content", "place", "line_words", "at")
        .agg(F.min("first_id").alias("first_id"))
        .groupBy("host", "line", "content")
        .agg(
            F.sum("line_words").alias("line_words"),
            F.max(F.col("place") == 0).alias("opens"),
            F.min("first_id").alias("first_id"),
            F.collect_list("at").alias("at"),
        )
    )


def lines_above_limits(lines: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, line, holder, n): lines above both limits, the id of the one that keeps each, and its documents."""
    hosts = lines.groupBy("host").agg(F.sum(F.col("opens").cast("long")).alias("host_docs"))
    return (
        lines.groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("line_docs"), F.min("first_id").alias("holder"))
        .filter(F.col("line_docs") > min_docs)
        .join(hosts, "host")
        .filter(F.col("line_docs") > share * F.col("host_docs"))
        .select("host", "line", "holder", F.col("line_docs").alias("n"))
    )


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    key: str = "doc_id",
    min_docs: int = 20,
    share: float = 0.005,
    keep_share: float = 0.3,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """``docs`` with counts, ``removed_words``, ``base_failed``, ``kept`` and ``clean_text``.

    ``clean_text`` is the text without the lines that are removed from it; all other
    lines are as they were. Where none is removed it is the text itself.

    One row for each row of ``docs``, all its columns first; columns of the same
    name as an added one are replaced. A null text is empty: it has no words and
    fails the base rules. A null host counts as the host '', a null key as the
    largest one. An empty table gives an empty result. Repeated rows get the same
    verdict.
    """
    lines = stored(host_lines(docs, text, host, key), "quality-lines")
    above = stored(lines_above_limits(lines, min_docs, share), "quality-above")
    removed = (
        hot_join(lines, above, ["host", "line"], lines.count())
        .filter(F.col("first_id") != F.col("holder"))
        .groupBy(F.col("host").alias("_host"), F.col("content").alias("_content"))
        .agg(F.sum("line_words").alias("_removed"), F.flatten(F.collect_list("at")).alias("_gone"))
    )
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept", "clean_text"]
    base = base_metrics(docs.drop(*(c for c in added if c not in (text, host, key))), text)
    keyed = base.withColumns(
        {
            "_host": F.coalesce(F.col(host), F.lit("")),
            "_content": _content_hash(F.coalesce(F.col(text), F.lit(""))),
            "base_failed": (F.col("n_words") < min_words)
            | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        }
    )
    joined = keyed.join(removed, ["_host", "_content"], "left")
    # Lines are a column of their own: a lambda would split the text anew for each of them.
    joined = joined.withColumn("_every", F.when(F.col("_removed") > 0, F.split(F.col(text), "\n")))
    # The places that stay, by set difference: linear in the lines, however many go.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_every") - 1), "_gone")
    rest = F.transform(stay, lambda i: F.get("_every", i))
    left = F.col("n_words") - F.coalesce(F.col("_removed"), F.lit(0))
    return joined.withColumns(
        {
            "removed_words": F.coalesce(F.col("_removed"), F.lit(0)).cast("long"),
            "kept": (F.col("_partition") >= 0) & ~F.col("base_failed") & (left >= keep_share * F.col("n_words")),
            "clean_text": F.when(F.col("_every").isNotNull(), F.array_join(rest, "\n")).otherwise(F.col(text)),
        }
    ).drop("_host", "_content", "_removed", "_gone", "_every", "_partition")
