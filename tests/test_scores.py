"""Scores to the last of their six decimals: how they are rounded, and what norms they are divided by."""

import duckdb
from pyspark.sql import functions as F

from fieldloom.functions.portable import rounded
from fieldloom.operators import matching as M
from fieldloom.plans import registry

SF = "/root/testdata/sf0.01"


def exactly(spark, name):
    """Rows of a query and of its SQL, with all their decimals."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    rows = found.fetchall()
    return sorted(map(tuple, registry.QUERIES[name](spark, SF).select(*names).collect())), sorted(rows)


def test_halves_are_told_by_the_scaled_double(spark):
    values = [k / 1e6 * w for k in range(10_000, 12_000) for w in (0.6, 0.7, 0.85, 0.9, 0.55)] + [0.0, -0.5e-6, 2.5e-6, float("nan"), float("inf"), None]
    con = duckdb.connect()
    expected = con.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", rounded("v", 6).alias("v")).orderBy("i")
    assert list(map(repr, (r["v"] for r in rows.collect()))) == list(map(repr, (r[0] for r in expected)))


def test_abstention_scores_to_the_last_decimal(spark):
    got, expected = exactly(spark, "abstention_scores")
    assert got == expected


def test_cosines_divide_by_the_norm_of_the_mean_itself(spark):
    # 1e-9 beside a norm of 1e-3 is a millionth of it; of the mean brought to unit length first it is nothing.
    rows = spark.createDataFrame([("a", [1e-3, 0.0])] * 3, "concept string, vector array<double>")
    means = M.prototypes(rows).select("concept", F.col("mean").alias("vector"))
    field = spark.createDataFrame([(1, [1.0, 0.0])], "field_key int, vector array<double>")
    assert [r["score"] for r in M.cosine_topk(field, means, 1).collect()] == [0.999999]


def test_ranked_cosines_use_the_mean_itself(spark):
    from fieldloom.plans.matching import representatives

    norms = [r[0] for r in representatives(spark, "/root/testdata/sf0.001").select(M.norm(F.col("vector"))).collect()]
    assert len(norms) == 8 and max(norms) < 0.99


def test_facet_scores_to_the_last_decimal(spark):
    got, expected = exactly(spark, "facet_retrieval")
    assert got == expected
