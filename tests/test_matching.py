"""Searches that leave rows where they are: nothing is shuffled, and blocks and steps of any size give the same."""

import io
from contextlib import redirect_stdout

import pytest

from quarry.functions import text as T
from quarry.operators import chunking, dense, lexical, matching, metrics, tables
from tests.test_queries import rows

WORDS = ["cat", "dog", "bird", "fish", "sleep", "run", "fly", "swim"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [" ".join(WORDS[(i * j + i // 3) % len(WORDS)] for j in range(1, i % 7 + 1)) for i in range(60)]
    return spark.createDataFrame([(i, t, "ab"[i % 2] if i % 5 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "cat dog cat"), (2, "bird swim fly"), (3, "none"), (4, "sleep run fish")], "query_id long, text string")


def moved(df) -> bool:
    with redirect_stdout(io.StringIO()) as said:
        df.explain("simple")
    return any("Exchange" in line and "Broadcast" not in line for line in said.getvalue().splitlines())


def small_steps(monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_ROWS", 3)
    monkeypatch.setattr(matching, "CELLS", 5)
    monkeypatch.setattr(dense, "QUERIES", 2)
    monkeypatch.setattr(metrics, "GRAMS", 20)


@pytest.mark.parametrize("by", [(), ("lang",)])
def test_documents_are_scored_where_they_are(docs, questions, by, monkeypatch):
    every = lexical.bm25(docs, questions, *by)
    best = lexical.bm25(docs, questions, *by, k=2)
    assert not moved(every) and not moved(best)
    whole = rows(lexical.top(every, 2, *by).toPandas())
    assert whole and rows(lexical.top(best, 2, *by).toPandas()) == whole
    small_steps(monkeypatch)
    assert rows(lexical.top(lexical.bm25(docs, questions, *by, k=2), 2, *by).toPandas()) == whole


def test_covering_documents_are_found_where_they_are(docs, questions, monkeypatch):
    found = lexical.covering(docs, questions, (6, 10))
    assert not moved(found)
    sets = lambda df, key: {r[key]: set(r["text"].split()) for r in df.collect()}
    want = {(q, d) for q, a in sets(questions, "query_id").items() for d, b in sets(docs, "doc_id").items() if 10 * len(a & b) >= 6 * len(a)}
    assert want and {tuple(r) for r in found.collect()} == want
    small_steps(monkeypatch)
    assert {tuple(r) for r in lexical.covering(docs, questions, (6, 10)).collect()} == want


def test_vectors_are_scored_where_they_are(spark, monkeypatch):
    values = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [0.0, 0.0], None, [1.0, None], [float("nan"), 1.0], [0.8, 0.6], [1.0]]
    corpus = spark.createDataFrame(list(enumerate(values)), "vec_id long, v array<double>")
    queries = spark.createDataFrame([(i, values[i]) for i in (0, 2, 4, 7, 8)], "query_id long, q array<double>")
    want = rows(dense.nearest(dense.scored(queries, corpus), 8).select("query_id", "rank", "vec_id", "score").toPandas())
    best = dense.best(queries, corpus, 8)
    assert not moved(best)
    assert rows(dense.nearest(best, 8).select("query_id", "rank", "vec_id", "score").toPandas()) == want
    small_steps(monkeypatch)
    assert rows(dense.nearest(dense.best(queries, corpus, 8), 8).select("query_id", "rank", "vec_id", "score").toPandas()) == want


def test_similar_pairs_where_they_are(docs, questions, monkeypatch):
    items, grams = questions.select(questions.query_id.alias("a"), T.ngrams(questions.text).alias("grams")), docs.select(docs.doc_id.alias("b"), T.ngrams(docs.text).alias("grams"))
    pairs = metrics.similar_pairs(items, grams, 0.1)
    assert not moved(pairs)
    left, right = ({r[0]: set(r[1]) for r in df.collect()} for df in (items, grams))
    want = {(a, b, round(len(x & y) / len(x | y), 6)) for a, x in left.items() for b, y in right.items() if x & y and len(x & y) >= 0.1 * len(x | y)}
    assert want and {tuple(r) for r in pairs.collect()} == want
    small_steps(monkeypatch)
    assert {tuple(r) for r in metrics.similar_pairs(items, grams, 0.1).collect()} == want


def test_soft_matches_by_brute_force(docs, questions, monkeypatch):
    ranked = lexical.top(lexical.bm25(docs, questions, k=6), 6).select("query_id", "doc_id", "rank")
    gold = lexical.covering(docs, questions, (9, 10))
    grams = {r[0]: set(r[1]) for r in docs.select("doc_id", T.ngrams(docs.text)).collect()}
    of = {}
    for q, d in gold.collect():
        of.setdefault(q, set()).add(d)
    near = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.3
    added = {}
    for q, d, _ in ranked.collect():
        if q in of and d not in of[q] and any(near(grams[d], grams[g]) for g in of[q]):
            added[q] = added.get(q, 0) + 1
    want = {(q, added.get(q, 0)) for q in of}
    assert added
    got = lambda: {(r["query_id"], r["added"]) for r in metrics.soft(ranked, gold, docs, [1, 3], 0.3).collect()}
    assert got() == want
    small_steps(monkeypatch)
    assert got() == want


def test_texts_are_packed_where_they_are(spark):
    texts = ["", None, "One. " * 300, "x" * 1500 + ". Two! Three?", "A" * 400 + ". " + "B" * 40 + ". " + "C" * 300 + "."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = chunking.pack_texts(docs, T.sentences, 512, 51, 51)
    assert not moved(packed)
    want = rows(chunking.pack_sentences(chunking.sentence_rows(docs, T.sentences), 512, 51, 51).toPandas())
    assert want and rows(packed.toPandas()) == want


def test_words_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tables, "WORDS", 10)
    words = spark.range(200).selectExpr("id % 40 AS page", "id AS word_id", "CAST(id % 7 AS double) AS x", "CAST(id % 90 AS double) AS y")
    lines = tables.text_lines(words, "page")
    assert lines.rdd.getNumPartitions() == 20
    assert lines.count() == 200
