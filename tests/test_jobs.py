"""Profiles by both ways: keys that are whole in a part, and keys of many rows."""

from pyspark.sql import functions as F

from fieldloom.operators import jobs as J
from fieldloom.operators import ordered as O
from fieldloom.plans import states

JOBS = [*states.JOBS[3:6], *states.JOBS[8:9], J.Job("by_nothing", ("empty", "l_linenumber"), "l_quantity", "l_partkey")]


def told(spark):
    rows = states._rows(spark, "/root/testdata/sf0.001").withColumn("empty", F.lit(None).cast("string"))
    return sorted(map(repr, J.profiles(rows, JOBS).collect()))


def test_keys_of_many_rows_have_the_same_profiles(spark, monkeypatch):
    whole = told(spark)
    for piece in (300, 3):
        monkeypatch.setattr(O, "PIECE", piece)
        assert told(spark) == whole


def test_rows_are_not_sent_once_a_job(spark):
    rows = states._rows(spark, "/root/testdata/sf0.001")
    found = J.profiles(rows, states.JOBS[:1])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange ") == 1 and "collect_list" not in plan
