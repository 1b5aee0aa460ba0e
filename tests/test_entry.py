import __spark_entry__ as entry


def test_queries_have_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "rank", "doc_id", "score"]
    assert frame.count() > 0
