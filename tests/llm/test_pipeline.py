"""Every stage on its own input, by brute force where there is one."""

import os

import pytest

import corpus_pipeline
from inkstat.llm import decontaminate, simhash

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
        if name == "dedup":
            want = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert seen[name] == want
        if name == "decontaminate":
            bad = decontaminate.mark(before, spark.read.parquet(f"{DIR}/benchmark.parquet")).where(decontaminate.contaminated())
            gone = {r["doc_id"] for r in bad.select("doc_id").collect()}
            assert gone and seen[name] == {r["doc_id"] for r in before.select("doc_id").collect()} - gone
    assert seen["packing"] == seen["decontaminate"] and len(seen["quality"]) > 100
