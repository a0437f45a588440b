"""Gold construction: verify, route, merge, correct, sample, agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import keep_first, tiered_match


def concept_status(pairs: DataFrame, concept: str, db: str, every: list[str]) -> DataFrame:
    """(concept, n_dbs, covered, missing, status): auto if all databases have it."""
    sets = pairs.groupBy(concept).agg(F.sort_array(F.collect_set(db)).alias("_s"), F.count(F.lit(1)).alias("n_source_pairs"))
    missing = F.array_except(F.array(*map(F.lit, every)), F.col("_s"))
    return sets.select(
        concept,
        F.size("_s").cast("long").alias("n_dbs"),
        F.array_join("_s", "+").alias("covered"),
        F.array_join(missing, "+").alias("missing"),
        F.when(F.size(missing) == 0, "auto").otherwise("queue").alias("status"),
        "n_source_pairs",
    )


def verify_pairs(pairs: DataFrame, catalogue: DataFrame, every: list[str], suffixed: list[str]) -> DataFrame:
    """Parsed (db, field_key, concept) against the catalogue's (db, field_key), with ``status``.

    A key of the databases ``suffixed`` may match by its last segments. Keys found nowhere
    are ``missing``; concepts that all databases have are ``auto``, others ``queue``.
    """
    names = catalogue.select("db", "field_key").distinct()
    parsed = pairs.select("db", "field_key", "concept").distinct()
    plain = ~F.col("db").isin(suffixed)
    exact = parsed.filter(plain).join(names, ["db", "field_key"]).withColumn("matched", F.col("field_key"))
    found = exact
    for db in suffixed:
        own = parsed.filter(F.col("db") == db)
        hits = tiered_match(own, names.filter(F.col("db") == db).select("field_key"), "field_key", "field_key")
        found = found.unionByName(own.join(hits.select("field_key", "matched"), "field_key"))
    status = concept_status(found, "concept", "db", every).select("concept", "covered", "missing", "status")
    lost = parsed.join(found.select("db", "field_key", "concept").distinct(), ["db", "field_key", "concept"], "left_anti")
    return found.join(status, "concept").unionByName(lost.withColumn("status", F.lit("missing")), allowMissingColumns=True)


def still_needed(queue: DataFrame, concept: str, missing: str) -> DataFrame:
    """(db, concept): what each database lacks, of '+'-joined sets."""
    return queue.select(F.explode(F.split(missing, r"\+")).alias("db"), concept).filter("db <> ''").distinct()


def shared_identifiers(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that two dictionaries have with the same label, but for case and outer blanks."""
    def names(df: DataFrame) -> DataFrame:
        return df.select(key, F.lower(F.trim(label)).alias("_label"))

    return names(a).join(names(b), [key, "_label"]).select(key).distinct()


def resolve_by_identity(queue: DataFrame, shared: DataFrame, present: DataFrame, key: str, db: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(resolved, still): rows of ``db`` that lack ``other`` and share their key with it.

    Their key must be in ``present``, too. A resolved row that lacks more stays in the
    queue, with ``other`` moved from ``missing`` to ``covered``.
    """
    known = shared.select(key).intersect(present.select(key)).withColumn("_known", F.lit(True))
    lacks, has = F.split("missing", r"\+"), F.split("covered", r"\+")
    told = queue.join(known, key, "left")
    hit = (F.col("db") == db) & F.array_contains(lacks, other) & F.coalesce("_known", F.lit(False))
    told = told.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_known")
    resolved = told.filter("_hit").drop("_hit").withColumn("db", F.lit(other))
    rest = F.array_join(F.array_sort(F.array_remove(lacks, other)), "+")
    now = F.array_join(F.array_sort(F.array_distinct(F.array_remove(F.array_append(has, F.lit(other)), ""))), "+")
    moved = told.withColumns({"missing": F.when(F.col("_hit"), rest).otherwise(F.col("missing")), "covered": F.when(F.col("_hit"), now).otherwise(F.col("covered"))})
    return resolved, moved.filter(~F.col("_hit") | (F.col("missing") != "")).drop("_hit")


def queue_resolved(queue: DataFrame, resolved: DataFrame, keys: list[str], missing: str, found: str) -> DataFrame:
    """A queue whose '+'-joined missing sets lose what was found; done rows go."""
    by_key = resolved.groupBy(*keys).agg(F.collect_set(found).alias("_found"))
    left = F.array_except(F.split(missing, r"\+"), F.coalesce("_found", F.array().cast("array<string>")))
    joined = queue.join(by_key, keys, "left").withColumn("_left", F.array_sort(left)).filter(F.size("_left") > 0)
    return joined.withColumn(missing, F.array_join("_left", "+")).drop("_left", "_found")


def route(verdicts: DataFrame, verdict: str) -> DataFrame:
    """Adds ``target``: gold for a concept, unknown or unsure for those words."""
    v = F.upper(F.trim(F.coalesce(F.col(verdict), F.lit(""))))
    target = F.when(v == "UNKNOWN", "unknown").when(v.isin("UNSURE", ""), "unsure").otherwise("gold")
    return verdicts.withColumn("target", target)


def merge(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both, without new rows whose key was there; the first of equal new ones."""
    both = existing.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return keep_first(both, keys, ["_age", *(c for c in rest if c != "_age")]).drop("_age")


def apply_corrections(gold: DataFrame, corrections: DataFrame, key: str, concept: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold, moved to unknown). A correction (key, new) relabels to a known concept,
    moves on UNKNOWN, deletes on DELETE, and does nothing on UNSURE or else."""
    names = known.select(F.col(concept).alias("new"), F.lit(True).alias("_known")).distinct()
    told = keep_first(corrections, [key], ["new"]).join(names, "new", "left")
    joined = gold.join(told, key, "left")
    new: Column = F.coalesce("new", F.lit("UNSURE"))
    relabelled = F.when(F.coalesce("_known", F.lit(False)), F.col("new")).otherwise(F.col(concept))
    kept = joined.filter(~new.isin("UNKNOWN", "DELETE")).withColumn(concept, relabelled)
    moved = joined.filter(new == "UNKNOWN")
    return kept.select(*gold.columns), moved.select(*gold.columns)


def weighted_rate(strata: DataFrame, errors: str, drawn: str, population: str) -> DataFrame:
    """Rate over strata that were sampled unevenly, weighted by their populations."""
    return strata.agg(
        F.sum(drawn).alias("n"),
        (F.sum(F.col(errors) / F.nullif(F.col(drawn).cast("double"), F.lit(0.0)) * F.col(population)) / F.sum(population)).alias("rate"),
    )
