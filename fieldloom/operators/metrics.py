"""Open-set metrics, curves, calibration, resampling and agreement, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import rounded
from . import ordered as O


def _sums(**parts: Column) -> list[Column]:
    return [F.count_if(c).alias(k) for k, c in parts.items()]


def recall_at(df: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row of percentages over rows (gold, rank of gold or null); null without gold."""
    of = F.nullif(F.count("gold"), F.lit(0))
    hits = [rounded(100 * F.count_if(F.col("gold").isNotNull() & (F.col("gold_rank") <= k)) / of, 4).alias(f"recall_{k}") for k in ks]
    return df.agg(F.count("gold").alias("n_gold"), *hits)


def open_set(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and coverage of (gold, predicted), null for UNKNOWN.

    A wrong concept is both a false positive and a false negative.
    """
    gold, told = F.col("gold"), F.col("predicted")
    right = gold.eqNullSafe(told)
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *_sums(
            tp=gold.isNotNull() & right,
            fp=told.isNotNull() & ~right,
            fn=gold.isNotNull() & ~right,
            over_assigned=gold.isNull() & told.isNotNull(),
            wrong=gold.isNotNull() & told.isNotNull() & ~right,
            missed=gold.isNotNull() & told.isNull(),
            assigned=told.isNotNull(),
        ),
    )

    def ratio(a: Column, b: Column) -> Column:
        return rounded(100 * a / F.nullif(b.cast("double"), F.lit(0.0)), 4)

    return counted.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
            "coverage": ratio(F.col("assigned"), F.col("n")),
        }
    )


def auroc(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """The U statistic with mean ranks of ties; null where one class is missing.

    Scores are counted first, so that ranks run over distinct scores, in pieces of the
    order: of all rows or of each key. With ``weight`` a row stands that many times.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    counts = df.groupBy(*keys, score).agg(F.sum(F.col(label) * n).alias("_p"), F.sum(n).alias("_n"))
    ranked = O.running(counts, score, {"_below": F.col("_n")}, keys=keys)
    ranked = ranked.withColumn("_rank", F.col("_below") - F.col("_n") + (F.col("_n") + 1) / 2)
    p, n = F.sum("_p"), F.sum("_n") - F.sum("_p")
    u = F.sum(F.col("_p") * F.col("_rank")) - p * (p + 1) / 2
    out = u / F.nullif((p * n).cast("double"), F.lit(0.0))
    return ranked.groupBy(*keys).agg(p.cast("long").alias("n_pos"), n.cast("long").alias("n_neg"), rounded(out, 6).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, tie: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision at the ranks of positives, averaged; ties by the numeric column ``tie``."""
    ranked = O.running(df, score, {"_r": F.lit(1), "_tp": F.col(label)}, tie, descending=True, keys=keys)
    hit = F.col(label) == 1
    return ranked.groupBy(*keys).agg(F.count_if(hit).alias("n_pos"), rounded(F.avg(F.when(hit, F.col("_tp") / F.col("_r"))), 6).alias("average_precision"))


def recall_of_scores(df: DataFrame, scores: str, target: str, ks: tuple[int, ...] = (1, 5, 10), ignore: int = -1) -> DataFrame:
    """Recall at k of rows of scores over all classes, in per cent; null without a target.

    Rows whose target is ``ignore`` are skipped; beyond the number of classes k is that
    number. Of equal scores the lower class stands first; minus infinity may be a score.
    """
    kept = df.filter(F.col(target) != ignore)
    own = F.get(scores, F.col(target).cast("int"))
    before = F.size(F.filter(F.col(scores), lambda x, i: (x > own) | ((x == own) & (i < F.col(target)))))
    rank = kept.select(before.alias("_before"), F.size(scores).alias("_classes"))
    hits = [rounded(100 * F.avg((F.col("_before") < F.least(F.lit(k), F.col("_classes"))).cast("int")), 4).alias(f"recall_{k}") for k in ks]
    return rank.agg(F.count(F.lit(1)).alias("n"), *hits)


def kappa_assigned(df: DataFrame, a: str, b: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Cohen's kappa on whether a concept was assigned at all."""

    def collapsed(c: str) -> Column:
        told = F.coalesce(F.col(c), F.lit(""))
        return F.when(told.isin("", "UNSURE"), told).when(told == unknown, unknown).otherwise("ASSIGNED")

    return kappa(df.select(collapsed(a).alias("_left"), collapsed(b).alias("_right")), "_left", "_right")


def calibrate(df: DataFrame, grid: DataFrame) -> DataFrame:
    """(theta, f1, tp, fp, fn) for each threshold of ``grid``; rows (gold, predicted, score).

    A histogram over the grid and running sums: no row meets more than one threshold.
    """
    right = F.col("gold").eqNullSafe(F.col("predicted"))
    steps = grid.agg(F.array_sort(F.collect_list("theta")).alias("_grid"))  # the grid is a parameter
    placed = df.crossJoin(F.broadcast(steps)).withColumn("_k", F.size(F.filter("_grid", lambda t: t <= F.col("score"))))
    histogram = placed.groupBy("_k").agg(F.count_if(right & F.col("gold").isNotNull()).alias("_tp"), F.count_if(~right).alias("_fp"), F.count("gold").alias("_g"))
    ranked = grid.withColumn("_i", F.row_number().over(Window.orderBy("theta")))
    joined = ranked.join(histogram, F.col("_k") >= F.col("_i"), "left").groupBy("theta").agg(
        F.coalesce(F.sum("_tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("_fp"), F.lit(0)).alias("fp")
    )
    total = df.agg(F.count("gold").alias("_gold"))
    out = joined.crossJoin(F.broadcast(total)).withColumn("fn", F.col("_gold") - F.col("tp")).drop("_gold")
    return out.withColumn("f1", rounded(100 * 2 * F.col("tp") / F.nullif((2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"), F.lit(0.0)), 4))


def best_threshold(calibrated: DataFrame, theta: str = "theta", value: str = "f1") -> DataFrame:
    """The first threshold of the best value."""
    best = F.max_by(F.struct(theta, value), F.struct(F.col(value), -F.col(theta)))
    return calibrated.agg(best.alias("_b")).select("_b.*")


def curve(df: DataFrame, score: str, right: str, tie: str) -> DataFrame:
    """(rank, coverage, precision) as candidates are accepted from the best score down.

    ``tie`` is a numeric column that tells equal scores apart.
    """
    ranked = O.running(df.select(score, tie, right), score, {"_r": F.lit(1), "_right": F.col(right)}, tie, descending=True)
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(total)).select(  # one row
        F.col("_r").alias("rank"),
        rounded(100 * F.col("_r") / F.col("_n"), 6).alias("coverage"),
        rounded(100 * F.col("_right") / F.col("_r"), 6).alias("precision"),
    )


def curve_area(points: DataFrame) -> DataFrame:
    """Trapezoids over coverage, divided by its range."""
    steps = O.sum_over_steps(points, "coverage", "rank", "coverage", "precision")
    x = F.col("coverage")
    span = points.agg(F.nullif(F.max(x) - F.min(x), F.lit(0.0)).alias("span"))
    return steps.crossJoin(F.broadcast(span)).select(rounded(F.col("total") / F.col("span"), 4).alias("area"))  # one row


def at_coverage(points: DataFrame, target: float) -> DataFrame:
    """The first point at or beyond a coverage; not interpolated."""
    return points.filter(F.col("coverage") >= target).agg(F.min_by(F.struct("coverage", "precision"), F.struct("coverage", "rank")).alias("_p")).select("_p.*")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa over rows on which both sides answered."""
    kept = df.filter(~F.coalesce(F.col(a), F.lit("")).isin("", "UNSURE") & ~F.coalesce(F.col(b), F.lit("")).isin("", "UNSURE"))
    table = kept.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    left, right = (table.groupBy(F.col(c).alias("c")).agg(F.sum("n").alias(f"n_{s}")) for c, s in ((a, "a"), (b, "b")))
    pe = left.join(right, "c").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("_e"))
    po = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agreed"))
    out = po.crossJoin(pe)
    e = F.coalesce("_e", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select("n", "agreed", rounded((F.col("agreed") / F.col("n") - e) / F.nullif(1 - e, F.lit(0.0)), 6).alias("kappa"))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return rounded(100 * (middle - half), 4), rounded(100 * (middle + half), 4)
