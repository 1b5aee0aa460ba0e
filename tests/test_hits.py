"""What is done with hits touches the documents that were returned, and no other."""

import io
import os
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import metrics
from quarry.plans import retrieval
from tests.conftest import DATA
from tests.test_queries import rows


def plan(df) -> str:
    with redirect_stdout(io.StringIO()) as said:
        df.explain("simple")
    return said.getvalue()


def test_coverage_makes_ngrams_of_returned_documents_alone(spark):
    texts = ["abcdefgh", "cdefghij", "xyz", "", None, "klmnopqrst"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (2, 3), (2, 4)], "query_id long, doc_id long")
    gold = spark.createDataFrame([(1, 1, "abcdefghijkl"), (2, 1, "xyz"), (3, 1, "klmno"), (4, 1, "")], "query_id long, gold_no int, text string")
    returned = docs.join(hits, "doc_id").select("query_id", T.ngrams(F.col("text")).alias("grams"))
    covered = metrics.coverage(gold.select("query_id", "gold_no", T.ngrams(F.col("text")).alias("grams")), returned)
    assert rows(covered.toPandas()) == rows(spark.createDataFrame([(1, 0.75, 1.0, 1.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 0.0)], "query_id long, coverage double, any_covered double, all_covered double").toPandas())
    assert not any("Filter" in line and "regexp_extract_all" in line for line in plan(covered).splitlines())


def shuffled_rows(spark) -> int:
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def sizes(spark, tmp_path_factory):
    """The smallest tables, and the same with documents eight times, in as many files."""
    out = []
    for times in (1, 8):
        at = tmp_path_factory.mktemp(f"times{times}")
        for file in os.listdir(DATA):
            if file != "documents.parquet":
                os.symlink(f"{DATA}/{file}", at / file)
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        copies = docs.crossJoin(spark.range(times).withColumnRenamed("id", "copy"))
        copies.withColumn("doc_id", F.col("doc_id") + F.col("copy") * 1_000_000).drop("copy").coalesce(1).write.parquet(str(at / "documents.parquet"))
        out.append(str(at))
    return out


@pytest.mark.parametrize("name", ["format_context", "metrics_at_k", "metrics_by_level", "first_hit_rank", "rerank_topk", "dedupe_hits"])
def test_postings_are_not_shuffled(spark, sizes, name):
    moved = []
    for at in sizes:
        before = shuffled_rows(spark)
        retrieval.QUERIES[name](spark, at).collect()
        moved.append(shuffled_rows(spark) - before)
    assert 0 < moved[1] < 2 * moved[0], moved
