"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import corpus_pipeline


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert 0 < out.count() <= docs.count()
            docs = out
    assert {"doc_id", "bin_id", "capacity"} <= set(out.columns)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
