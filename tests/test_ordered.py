"""Running sums in pieces against one plain pass, with heavy ties, nulls and no rows."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import ordered as O


def rows_of(case):
    rng = random.Random(case)
    if case == "spread":
        return [(rng.random(), i, i % 3) for i in range(3000)]
    if case == "one score":
        return [(1.0, i, i % 3) for i in range(3000)]
    if case == "few scores":
        return [(float(rng.randrange(4)), i, i % 3) for i in range(3000)]
    if case == "nulls":
        return [(None if i % 3 == 0 else rng.random() // 0.2, None if i == 5 else i, i % 3) for i in range(3000)]
    return [(float("nan"), i, 1) if i % 4 == 0 else (float(i % 7), i, 2) for i in range(800)] if case == "nan" else []


def place(row, descending):
    score, tie, _ = row
    if score is None:
        group, s = (1 if descending else 0), 0.0
    else:
        nan = score != score
        group = (0 if descending else 1)
        s = (float("inf") if nan else score) * (-1 if descending else 1)
    return group, s, tie is not None, tie or 0


@pytest.mark.parametrize("piece", [100, 1_000_000])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("case", ["spread", "one score", "few scores", "nulls", "nan", "empty"])
def test_running_sums(spark, monkeypatch, case, descending, piece):
    monkeypatch.setattr(O, "PIECE", piece)
    rows = rows_of(case)
    df = spark.createDataFrame(rows, "score double, tie long, v long").repartition(3)
    found = O.running(df, "score", {"rank": F.lit(1), "total": F.col("v")}, "tie", descending)
    expected, total = {}, 0
    for rank, row in enumerate(sorted(rows, key=lambda r: place(r, descending)), 1):
        total += row[2]
        expected[row[1]] = (rank, total)
    assert {r["tie"]: (r["rank"], r["total"]) for r in found.collect()} == expected
    assert found.columns == ["score", "tie", "v", "rank", "total"]


def test_no_piece_holds_a_hot_score(spark, monkeypatch):
    monkeypatch.setattr(O, "PIECE", 100)
    df = spark.createDataFrame(rows_of("one score"), "score double, tie long, v long")
    cut, pieces = O.in_pieces(df, [F.asc("score"), F.asc("tie")])
    most = cut.groupBy("_piece").count().agg(F.max("count")).first()[0]
    assert pieces == 31 and most < 200


@pytest.mark.parametrize("piece", [100, 1_000_000])
def test_steps(spark, monkeypatch, piece):
    monkeypatch.setattr(O, "PIECE", piece)
    rows = [(float(i % 50), i, float(i * 7 % 13)) for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, tie long, y double")
    line = sorted(rows)
    plain = sum((b[0] - a[0]) * (a[2] + b[2]) / 2 for a, b in zip(line, line[1:]))
    assert O.sum_over_steps(df, "x", "tie", "x", "y").first()["total"] == pytest.approx(plain)
