import numpy as np

from quarry.llm import langid
from tests.conftest import DATA


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = langid.train(docs)
    rows = langid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.9


def test_odd_rows(odd, plain):
    rows = langid.identify(odd, langid.train(odd)).collect()
    assert len(rows) == len(plain)
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["lang_pred"] in ("xx", "und")
    by = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] is not None}
    assert [by[i] for i in (0, 1, 2, 13)] == ["und"] * 4
    assert by[3] == by[11] == "xx"


def test_tables_equal_the_filters():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], np.arange(256, dtype=np.uint8) % langid.CLASSES, rng)
    codes = rng.integers(0, langid.CLASSES, (7, langid.WINDOW)).astype(np.uint8)
    pooled, _ = net.pooled(np.pad(codes, ((0, 0), (0, 3))).astype(np.int64))
    expected = langid.softmax(pooled @ net.out + net.bias)
    assert np.allclose(langid.Scorer(net).probabilities(codes), expected, atol=1e-5)


def test_rejection_keeps_columns(odd, empty):
    net = langid.train(odd)
    kept = langid.in_known_language(odd, net)
    assert kept.columns == odd.columns
    assert {0, 1, 2, 13}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert langid.in_known_language(empty, langid.train(empty)).count() == 0


def test_symbols_are_no_letters(spark):
    """Fractions, superscripts and circled digits; one letter of any script is enough."""
    texts = ["\u00bd \u00b2 \u2460", "\u2160\u2161", "\u00b2\u00e9", "12 _ \u6f22", None, "\u0301"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(100 + i, "some words", "en") for i in range(9)], "doc_id long, text string, lang string")
    net = langid.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, net).collect()}
    assert [got[i] for i in (0, 1, 4, 5)] == [("und", 0.0)] * 4 and [got[i][0] for i in (2, 3)] == ["en", "en"]
    for known in (net, None):
        assert {r["doc_id"] for r in langid.in_known_language(docs, known).collect()} == {2, 3, *range(100, 109)}


def test_the_sample_is_the_same_in_every_run(spark):
    """All labelled rows share a doc_id, so all have one hash."""
    rows = [(1, f"word{i} and more", "ab"[i % 2]) for i in range(60)]
    fit = lambda n: langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n), documents=20)
    a, b = fit(1), fit(4)
    assert all(np.array_equal(x, y) for x, y in zip(a.filters, b.filters, strict=True))


def test_least_scores():
    assert [langid.least_score(n) for n in (0, 1, 2)] == [0.0] * 3 and langid.least_score(4) == 0.3
