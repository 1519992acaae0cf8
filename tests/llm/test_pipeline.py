"""The pipeline stage by stage on the smallest tables."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from netloom.llm.common import materialise, table

    docs = table(spark, DATA, "documents")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = materialise(stage(spark, docs, DATA))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and after
        if name != "sequences":
            assert docs.columns == columns
        if name in ("privacy", "sequences"):
            assert after == before
    assert len(after) < seen
