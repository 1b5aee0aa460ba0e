import corpus_pipeline
from quarry.llm import minhash, queries
from tests.conftest import DATA


def test_stages(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, DATA)
        assert docs.columns == odd.columns, name
    assert docs.count() > 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    kept = {r["doc_id"] for r in rows.collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = {r["doc_id"] for r in minhash.near_duplicates(docs).filter("kept").collect()}
    assert kept and kept <= first
    assert "pipeline" not in queries.queries()


def test_queries_have_ten_names():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
