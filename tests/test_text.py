import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, conversation, dense, filters, streams, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "pages"), [("- 2 -", [2]), ("-5-", [5]), ("- 41 - - 42 -", [41, 42]), ("- 1405 -", None), ("- 07 -", None), ("- 0 -", None), ("- 41 - - 43 -", None), ("- ５ -", None)])
def test_page_marker(spark, text, pages):
    assert one(spark, T.page_marker(F.lit(text))) == pages


def test_normalize_is_idempotent(spark):
    text = "\n\n  indent \r\nx\t\n\n\n\ny ······ 04\r"
    once = one(spark, T.normalize_text(F.lit(text)))
    assert once == "  indent\nx\n\ny   04"
    assert one(spark, T.normalize_text(F.lit(once))) == once
    assert one(spark, T.normalize_text(F.lit(None).cast("string"))) == ""


def test_sentences_tile_the_text(spark):
    text = "One. Two!  Three?\nfour . five"
    assert "".join(one(spark, T.sentences(F.lit(text)))) == text


def test_jaccard_of_empty_sets(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty)) == 0
    assert one(spark, T.ngrams(F.lit("abcd"))) == []
    assert one(spark, T.ngrams(F.lit("a-bcdef"))) == ["abcde", "bcdef"]


def test_strategy():
    assert T.default_overlap(1024) == 102
    with pytest.raises(ValueError):
        T.strategy_id(10, 10)


def test_nfc(spark):
    assert one(spark, T.nfc(F.lit("é"))) == "é"


def test_rowspan_fill_and_cover(spark):
    cells = spark.createDataFrame([(1, 1, 1, 2, 1, "a"), (1, 1, 2, 1, 1, "b"), (1, 2, 2, 1, 1, "c")], "k int, row int, col int, row_span int, col_span int, value string")
    grid = tables.filled(cells, "k")
    assert sorted((r.grid_row, r.grid_col, r.value) for r in grid.collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "c")]
    assert tables.exact_cover(grid, "k").first()["exact"]
    twice = cells.union(cells.limit(1))
    assert not tables.exact_cover(tables.filled(twice, "k"), "k").first()["exact"]


def test_hits_are_deduplicated_among_kept_ones(spark):
    hits = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "x"), (1, 3, "b", "y"), (1, 4, "", "")], "q int, rank int, id string, text string")
    kept = conversation.deduplicated_hits(hits, "q", "rank", "id", "text").collect()
    assert sorted(r["rank"] for r in kept) == [1, 3, 4]


def test_mmr_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = rng.normal(size=4)
    score = v @ (q / np.linalg.norm(q))
    rows = spark.createDataFrame([(0, i, float(score[i]), v[i].tolist()) for i in range(12)], "query_id long, vec_id long, score double, v array<double>")
    got = [r["vec_id"] for r in dense.diversified(rows, 5).orderBy("rank").collect()]
    chosen = [int(np.argmax(score))]
    while len(chosen) < 5:
        rest = [i for i in range(12) if i not in chosen]
        chosen.append(max(rest, key=lambda i: 0.5 * score[i] - 0.5 * max(v[i] @ v[j] for j in chosen)))
    assert got == chosen


def test_stream_spans(spark):
    rows = spark.createDataFrame([(1, 1, "ab", True, "s"), (1, 2, "", False, "s"), (1, 3, "cde", True, "s"), (1, 4, "f", True, "t")], "doc_id int, block_order int, block_text string, indexable boolean, section string")
    out = streams.char_spans(streams.text_streams(rows, "section")).orderBy("block_order").collect()
    assert [(r.stream_no, r.char_start, r.char_end) for r in out] == [(1, 0, 2), (1, 4, 7), (2, 0, 1)]


@pytest.mark.parametrize(("text", "heading"), [("Ⅰ 추진개요", "Ⅰ 추진개요"), ("\n Ⅳ.  개요\n", "Ⅳ. 개요"), ("Ⅹ) 부록", "Ⅹ) 부록"), ("a\nb\n제 3 장 범위", "제 3 장 범위"), ("제2장범위", "제2장범위"), ("IV. 개요", None), ("a\nb\nc\nⅠ 개요", None), ("Ⅰ " + "x" * 199, None), ("Ⅰ", None)])
def test_headings(spark, text, heading):
    assert one(spark, T.heading_of(F.lit(text))) == heading


@pytest.mark.parametrize(("text", "out"), [("<IMG src=a> <p>x</P><br/> <li", "&lt;IMG src=a&gt; &lt;p&gt;x&lt;/P&gt;&lt;br/&gt; &lt;li"), ("a > b <H/W 공통> <tfoot> <col> <pre>", "a > b <H/W 공통> <tfoot> <col> <pre>"), ("<script>x</script><caption>", "&lt;script&gt;x&lt;/script&gt;&lt;caption&gt;")])
def test_tags(spark, text, out):
    assert one(spark, T.neutralize_tags(F.lit(text))) == out


def test_cells_are_normalised(spark):
    assert one(spark, T.escape_cell(F.lit("\n a|b \r\n\r\n\r\nc\\d ·····e\n"))) == " a\\|b / c\\\\d  e"


@pytest.mark.parametrize(("text", "out"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ("see [1, 2] and {x", "[1, 2]"), ('at [1], [2] or {"a": 1}', '{"a": 1}'), ('so {"a": [1]} it is', '{"a": [1]}'), ('[{"a": 1}, {"a": 2}] ok', '[{"a": 1}, {"a": 2}]'), ("no {x} or [y]", None), ("", None), (None, None), ("{broken}", "{broken}")])
def test_json_of_answers(spark, text, out):
    assert one(spark, T.json_text(F.lit(text).cast("string"))) == out


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a", 100, True, "x"), (2, "b", 95, None, "x"), (3, None, None, True, " \n"), (4, "c", 96, True, None)], "id int, m string, token_count int, ok boolean, text string")
    ids = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert ids(rows.filter(filters.matching({}))) == [1, 2, 3, 4]
    assert ids(rows.filter(filters.matching({"m": {"$in": ["a", "c"]}, "token_count": 96}))) == [4]
    assert ids(rows.filter(~filters.matching({"m": "a"}))) == [2, 3, 4]
    assert ids(filters.long_enough(rows)) == [1, 4]
    assert ids(rows.filter(filters.eligible(["ok"]))) == [1]
    hits = spark.createDataFrame([(1,), (9,)], "id int")
    assert {r["id"]: r["text"] for r in filters.with_texts(hits, rows, "id").collect()} == {1: "x", 9: ""}
    with pytest.raises(ValueError):
        filters.matching({"m": {"$gt": 1}})


def test_windows_of_long_texts(spark):
    """A text of ten million characters is cut in one pass."""
    text = F.concat(F.repeat(F.lit("abcdé"), 2_000_000), F.lit("end"))
    out = chunking.stride_windows(spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text")))
    n, last, size = out.agg(F.count("*"), F.max("char_end"), F.sum(F.length("chunk_text"))).first()
    assert (last, n) == (10_000_003, -(-(10_000_003 - 102) // 410)) and size == 10_000_003 + (n - 1) * 102
    assert len(chunking.pack([10] * 50_000, 512, 51)) > 1000
