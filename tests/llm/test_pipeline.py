import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert sorted(docs.columns) == sorted(columns) and docs.count() <= n
        n = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} <= ids and mixed.count() > len(ids)
