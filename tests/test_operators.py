"""Sources, sinks, metrics and streams on small relations."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import matching as M
from fieldloom.operators import metrics as K
from fieldloom.operators import relational as R
from fieldloom.operators import workflow as L
from fieldloom.sources import readers, writers
from fieldloom.streaming.hourly import hourly_means


def test_csv_is_strings_without_a_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,v\n1,\n2,x\n".encode())
    df = readers.csv_strings(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "v"] and [tuple(r) for r in df.collect()] == [("1", None), ("2", "x")]


def test_csv_keeps_quotes_and_separators(spark, tmp_path):
    rows = [("a, b", 'say "x"'), (None, 'z"'), ("q", "1,2")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert writers.write(df, str(tmp_path / "q.csv")) == 3
    assert {tuple(r) for r in readers.csv_strings(spark, str(tmp_path / "q.csv")).collect()} == set(rows)


def test_csv_inventory_counts_lines_and_quoted_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"x, y","p ""q""",z\n1,2,3\n4,5,6\n')
    (tmp_path / "b.csv").write_text("only\n")
    found = {r["file"].rsplit("/", 1)[1]: (r["rows"], r["cols"]) for r in readers.csv_inventory(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": (2, 3), "b.csv": (0, 1)}
    names = readers.headers(spark, str(tmp_path / "a.csv")).collect()
    assert {(r["ordinal"], r["column_name"]) for r in names} == {(0, "x, y"), (1, 'p "q"'), (2, "z")}


def test_resolved_rows_leave_the_queue(spark):
    queue = spark.createDataFrame([("1", "a", "b", "a"), ("2", "a", "b+c", "a"), ("3", "a", "b", None), ("4", "c", "b", "c"), (None, "a", "b", "a")], "k string, db string, missing string, covered string")
    shared = spark.createDataFrame([("1",), ("2",), ("4",)], "k string")
    resolved, still = L.resolve_by_identity(queue, shared, shared, "k", "a", "b")
    assert {(r["k"], r["db"]) for r in resolved.collect()} == {("1", "b"), ("2", "b")}
    assert {(r["k"], r["missing"], r["covered"]) for r in still.collect()} == {("2", "c", "a+b"), ("3", "b", None), ("4", "b", "c"), (None, "b", "a")}


def test_steps_resume(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.step(spark, str(tmp_path / "s"), make).count() == 3
    assert len(made) == 1


def test_one_failed_job_stops_no_other(spark, tmp_path):
    jobs = {"good": lambda: spark.range(2), "bad": lambda: spark.table("no_such_table"), "csv.csv": lambda: spark.range(1)}
    done = {r["name"]: r for r in writers.run_jobs(spark, jobs, str(tmp_path)).collect()}
    assert done["good"]["rows"] == 2 and done["csv.csv"]["rows"] == 1 and done["bad"]["error"]


def test_missing_sources_are_left_out(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "x"))
    assert readers.if_there(spark, [str(tmp_path / "x"), str(tmp_path / "y")]).count() == 2
    assert readers.if_there(spark, [str(tmp_path / "y")]) is None


def test_inventory_headers_and_texts(spark, tmp_path):
    (tmp_path / "inv.tsv").write_text("d\tf.csv\t12\t2\t3\n")
    assert readers.inventory(spark, str(tmp_path / "inv.tsv")).first()["rows"] == 2
    (tmp_path / "h.csv").write_text("a,b\n1,2\n")
    assert {(r["ordinal"], r["column_name"]) for r in readers.headers(spark, str(tmp_path / "h.csv")).collect()} == {(0, "a"), (1, "b")}
    (tmp_path / "q.sql").write_text("SELECT 1\n-- x")
    assert readers.whole_texts(spark, str(tmp_path)).first()["text"].startswith("SELECT")


def test_append_merge_keeps_the_old(spark):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert {tuple(r) for r in writers.append_merge(old, new, ["k"]).collect()} == {(1, "old"), (2, "new")}


def test_unpivot_has_a_row_for_each_filled_cell(spark):
    df = spark.createDataFrame([(1, "2", None), (2, None, "3.5")], "id int, a string, b string")
    assert {tuple(r) for r in R.unpivot(df, ["id"], ["a", "b"], "f", "v").collect()} == {(1, "a", 2.0), (2, "b", 3.5)}


def test_auroc_is_null_for_one_class_and_half_for_ties(spark):
    rows = spark.createDataFrame([(1.0, 1), (1.0, 0)], "s double, y int")
    assert K.auroc(rows, "s", "y").first()["auroc"] == 0.5
    assert K.auroc(rows.filter("y = 1"), "s", "y").first()["auroc"] is None


def test_auroc_does_not_change_under_monotone_maps(spark):
    rows = spark.range(200).select((F.col("id") * 37 % 101).cast("double").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    assert K.auroc(rows, "s", "y").first() == K.auroc(rows.withColumn("s", F.exp(F.col("s") / 50)), "s", "y").first()


@pytest.mark.parametrize("most", [20_000, 2])
def test_topk_is_the_same_in_blocks(spark, most):
    f = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(9)], "field_key int, vector array<double>")
    c = spark.createDataFrame([(i, [float(i), 2.0, 1.0]) for i in range(7)], "concept int, vector array<double>")
    got = {(r["field_key"], r["rank"]): r["concept"] for r in M.cosine_topk(f, c, 3, most).collect()}
    full = M.cosine_topk(f, c, 7).filter("rank <= 3").collect()
    assert got == {(r["field_key"], r["rank"]): r["concept"] for r in full}


def test_cards_replace_small_classes(spark):
    v = spark.createDataFrame([("a", [3.0, 4.0])] * 3 + [("b", [1.0, 0.0])], "concept string, vector array<double>")
    cards = spark.createDataFrame([("b", [0.0, 2.0]), ("c", [1.0, 1.0])], "concept string, vector array<double>")
    got = {r["concept"]: (r["source"], [round(x, 3) for x in r["vector"]]) for r in M.prototypes(v, cards).collect()}
    assert got == {"a": (0, [0.6, 0.8]), "b": (1, [0.0, 1.0]), "c": (1, [0.707, 0.707])}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:10:00", "b", 5.0)], "ts string, field_key string, value_num double")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = hourly_means(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hours").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("hours").collect()) == sorted(hourly_means(rows).collect())
