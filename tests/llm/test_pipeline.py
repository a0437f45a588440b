"""The pipeline's stages, each on what its predecessor kept."""

import re
from pathlib import Path

import corpus_pipeline
from fieldloom.llm import secrets
from fieldloom.llm.common import stored

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = []
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        docs = stored(stage(spark, docs, DATA), "test")
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality_rules":
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= 20 for r in rows)
        if name == "near_duplicates":
            assert len({r["text"] for r in rows}) == len(rows) == len(after) and len(after) < len(before)
        if name == "secrets":
            assert set(after) == set(before) and not any(secrets.base_spans(r["text"]) for r in rows)
        if name == "mixing":
            assert set(after) == set(before) and all(r["taken"] <= 2 * r["size"] for r in rows)
        else:
            before = {i: r["text"] for i, r in after.items()}
    assert names == ["quality_rules", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"
