"""Small relational operators with fixed ties: mode, first, top, unpivot, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import rounded


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in ``order``. Ties are any row: order by all that matters."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn(rank, n).filter(F.col(rank) <= k)


def mode_per_key(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals; nulls do not count.

    Counts are aggregated before the keys meet, so a hot key is a few rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best["v"].alias(name))


def unpivot(df: DataFrame, ids: list[str], values: list[str], key: str, value: str) -> DataFrame:
    """Wide to long in one scan; empty cells are no rows."""
    typed = df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values))
    return typed.unpivot(ids, values, key, value).filter(F.col(value).isNotNull())


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return rounded(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def suffixes(key: Column) -> Column:
    """All parts of a ``a|b|c`` key that end it, the longest first."""
    parts = F.split(key, r"\|")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "|"))


def tiered_match(keys: DataFrame, catalogue: DataFrame, key: str, full: str) -> DataFrame:
    """Each key's catalogue entries of the best tier: 0 exact, 1 a suffix of the entry,
    2 all that follows the entry's first bar. Equi-joins on exploded suffixes, no theta join.
    """
    entries = catalogue.select(F.col(full).alias("_full")).distinct()
    tail = F.substring(F.col("_full"), F.instr("_full", "|") + F.lit(1), F.length("_full"))
    ways = entries.select("_full", F.posexplode(suffixes(F.col("_full"))).alias("_i", "_way"))
    tiers = ways.select("_full", "_way", F.when(F.col("_i") == 0, 0).otherwise(1).alias("tier")).unionByName(
        entries.filter(F.col("_full").contains("|")).select("_full", tail.alias("_way"), F.lit(2).alias("tier"))
    )
    hits = keys.select(key).distinct().join(tiers, F.col(key) == F.col("_way"))
    best = hits.groupBy(key).agg(F.min("tier").alias("tier"))
    return hits.join(best, [key, "tier"]).select(key, F.col("_full").alias("matched"), F.col("tier").cast("long")).distinct()


def jaccard_of_sets(pairs: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n_both, n_any, jaccard) for each two groups, by co-occurrence of items."""
    flat = pairs.select(group, item).distinct()
    sizes = flat.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    names = sizes.select(F.col(group).alias("a"), F.col("n").alias("na"))
    others = sizes.select(F.col(group).alias("b"), F.col("n").alias("nb"))
    both = (
        flat.withColumnRenamed(group, "a")
        .join(flat.withColumnRenamed(group, "b"), item)
        .filter(F.col("a") < F.col("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n_both"))
    )
    # A row for each two groups: groups are databases, of which there are a few.
    out = names.join(others, F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    n_both = F.coalesce("n_both", F.lit(0))
    return out.select("a", "b", n_both.cast("long").alias("n_both"), (F.col("na") + F.col("nb") - n_both).alias("n_any")).withColumn(
        "jaccard", share(F.col("n_both"), F.col("n_any"), 6)
    )


def bottom_per_key(df: DataFrame, key: str, order: list[Column], wanted: Column, most: int, rank: str = "rank") -> DataFrame:
    """The first ``wanted`` rows of each key, which differ by key and are at most ``most``.

    A task sends at most ``most`` rows of a key: a limit of a literal reaches below the
    exchange, one that differs by key does not, and is applied to what is left.
    """
    first = top_per_key(df, [key], order, most, rank)
    return first.filter(F.col(rank) <= wanted)


def stratified_sample(df: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """The rows of each stratum whose seeded digests come first: as many as it asks for."""
    order = F.md5(F.concat(F.lit(seed), F.lit("-"), F.col(key).cast("string")))
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col(stratum))
    asked = df.filter(F.col(stratum).isin(list(sizes)))
    return bottom_per_key(asked, stratum, [order, F.col(key)], wanted, max(sizes.values()), "draw")


def batches(df: DataFrame, group: list[str], order: list[str], item: str, size: int) -> DataFrame:
    """Groups of ``size`` consecutive items: (group, batch, items)."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    numbered = df.withColumn("_p", place).withColumn("batch", F.floor(F.col("_p") / size).cast("long"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(item).alias("x")))), lambda s: s["x"])
    return numbered.groupBy(*group, "batch").agg(listed.alias("items"))


def manifest(chunks: DataFrame, group: list[str], batch: str, items: str) -> DataFrame:
    """One row for each chunk: its size, first and last item."""
    return chunks.select(
        *group, batch, F.size(items).cast("long").alias("n"), F.get(items, F.lit(0)).alias("first"), F.element_at(items, -1).alias("last")
    )


def first_filled(df: DataFrame, candidates: list[str]) -> Column:
    """The first of those columns that exist in which something is written, trimmed; else null."""
    there = [F.nullif(F.trim(c), F.lit("")) for c in candidates if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def verify_rows(counts: DataFrame, expected: DataFrame, key: str, strict: Column) -> DataFrame:
    """Found and expected rows side by side, and whether they agree where they must."""
    joined = counts.join(expected, key, "full_outer")
    same = F.col("rows").eqNullSafe(F.col("expected_rows"))
    return joined.withColumn("ok", same | ~strict)


def canonical_drugs(df: DataFrame, src_table: str, stay: str, drug: str, at: Column, amount: str, unit: str | None) -> DataFrame:
    """A drug table in the canonical shape: the value is its rate or its dose."""
    return df.select(
        F.expr(f"try_cast({stay} AS bigint)").alias("stay_key"),
        F.col(drug).cast("string").alias("field_key"),
        at.cast("long").alias("t_offset"),
        F.expr(f"try_cast({amount} AS double)").alias("value_num"),
        (F.col(unit) if unit else F.lit(None)).cast("string").alias("value_uom"),
        F.lit(src_table).alias("src_table"),
    )


def category_members(dictionary: DataFrame, category: str, wanted: list[tuple[list[str], Column | None]]) -> DataFrame:
    """Rows whose category is listed, each list under its own condition (or none)."""
    keep = F.lit(False)
    for names, when in wanted:
        own = F.col(category).isin(names)
        keep = keep | (own if when is None else own & F.coalesce(when, F.lit(False)))
    return dictionary.filter(keep)


def age_years(age: Column) -> Column:
    """Years of an age as it is written; above a limit (``> 89``) one more than the limit."""
    plain = F.trim(age)
    limit = F.try_to_number(F.regexp_extract(plain, r"^>\s*(\d+)$", 1), F.lit("999")).cast("double") + 1
    return F.coalesce(limit, plain.try_cast("double"))


def cohort(stays: DataFrame, first: Column, days: Column, age: Column) -> DataFrame:
    """First stays of a day or more of adults."""
    return stays.filter(first & (days >= 1.0) & (age >= 18))


def profile_fields(facts: DataFrame, keys: list[str], value: str, entity: str, limit: int | None = None) -> DataFrame:
    """Rows, entities and number statistics of any key, most frequent first."""
    out = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(entity).alias("n_entities"),
        F.count(value).alias("n_numeric"),
        rounded(F.min(value), 4).alias("v_min"),
        rounded(F.avg(value), 4).alias("v_avg"),
        rounded(F.max(value), 4).alias("v_max"),
        rounded(F.median(value), 4).alias("v_median"),
    )
    return out if limit is None else out.orderBy(F.desc("n"), *keys).limit(limit)


def channel_means(values: DataFrame, mapping: DataFrame, keys: list[str], field: str, value: str) -> DataFrame:
    """The mean of field means of each channel, every field alike; fields of no channel are left out."""
    per_field = values.groupBy(*keys, field).agg(F.avg(value).alias("_m"))
    return per_field.join(mapping, field).groupBy(*keys, "channel").agg(F.avg("_m").alias("value"))
