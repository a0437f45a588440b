"""The pipeline's stages on nulls, repeated ids with other texts, no rows and extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import common

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def words(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n))


def rows():
    near = [f"n{k}" for k in range(80)]
    return [
        (1, words("a", 40), "en", "s", 1),
        (1, words("b", 40), "en", "s", 2),
        (2, words("a", 40), "en", "s", 1),
        (3, " ".join(near), None, None, None),
        (4, " ".join([*near[:79], "other"]), "en", "t", 4),
        (5, None, "en", "s", None),
        (6, "", "en", "s", 0),
        (None, words("c", 40), "en", "s", 1),
        (None, words("c", 40), "en", "s", 1),
        (None, words("d", 40), "en", None, 1),
        (8, words("e", 30_000), "en", "t", 9),
        (1, words("a", 40), "en", "s", 1),
        (9, words("f", 30) + ' password = "hunter2hunter" ' + words("g", 30), "en", "s", 1),
    ]


@pytest.fixture(params=["full", "empty"])
def case(spark, request, tmp_path):
    made = rows() if request.param == "full" else []
    docs = spark.createDataFrame(made, SHAPE).withColumns({c: F.lit("clash") for c in ("kept", "secrets", "hits", "size", "name", "label")})
    spark.createDataFrame([(1, words("f", 30)), (None, words("e", 30_000)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, str(tmp_path), request.param == "full"


def test_every_stage(spark, case):
    docs, sf_dir, full = case
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        found = [tuple(r) for r in got.collect()]
        if name != "mixing":
            assert got.columns == list(corpus_pipeline.COLUMNS)
        if not full:
            assert found == []
            continue
        ids = sorted((r[0] is None, r[0], (r[1] or "")[:2]) for r in found)
        if name == "quality_rules":
            assert not any(r[0] in (5, 6) for r in found) and len(found) == len(rows()) - 2
        if name == "near_duplicates":
            assert ids == [(False, 1, "a0"), (False, 1, "b0"), (False, 3, "n0"), (False, 5, ""), (False, 6, ""), (False, 8, "e0"), (False, 9, "f0"), (True, None, "c0"), (True, None, "d0")]
            assert sorted(map(repr, stage(spark, docs, sf_dir).collect())) == sorted(map(repr, got.collect()))
        if name == "decontamination":
            assert not any(r[0] in (8, 9) for r in found) and len(found) == len(rows()) - 2
        if name == "secrets":
            assert len(found) == len(rows()) and not any("hunter2" in (r[1] or "") for r in found)
        if name == "mixing":
            assert len(found) == len(rows()) and all(r["taken"] <= 2 * r["size"] for r in got.collect())


def test_run_keeps_no_tables_but_its_last(spark):
    before = common.stored_paths()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = common.stored_paths() - before
    assert len(left) == 1 and "stage-mixing" in next(iter(left))
    for r in out.collect():
        assert sum(len(p["text"].split()) for p in r["pieces"]) == r["taken"]
