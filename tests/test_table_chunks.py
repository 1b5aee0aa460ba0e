"""Chunks of tables against literal expectations and laws."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.table_chunks import BARE, FLATTENED, HEADER, HEADER_EXHAUSTED, HEADER_SPLIT, ROW_SPLIT, ROWS_AND_HEADER, chunked, fallback, parse, parts, pieces

TABLE = "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |"


def test_segments_take_the_lines_ahead_of_them():
    one, two, three = parse(f"caption\n\n{TABLE}\nbetween\n| lone |\nafter | all")
    assert one.header == "caption\n| a | b |\n| --- | --- |" and len(one.rows) == 3
    assert (two.header, two.rows) == (f"between\n{BARE}", ("| \\| lone \\| |",))
    assert (three.header, three.rows) == (BARE, ("| after \\| all |",))


def test_nothing_gives_no_segment():
    assert parse(None) == parse("") == parse(" \n ") == []
    assert parse(fallback(None))[0].rows == ("| (내용 없음) |",)


def test_rows_share_a_part_while_they_fit():
    (segment,) = parse(TABLE)
    assert [p.row_end for p in parts(segment, 100)] == [3]
    first, second = parts(segment, len(segment.header) + 20)
    assert (first.row_start, first.row_end, second.row_start, second.row_end) == (1, 2, 3, 3)
    assert (first.repeated, second.repeated, second.mode) == (False, True, HEADER)


def test_whole_rows_are_repeated():
    (segment,) = parse(TABLE)
    first, second = parts(segment, len(segment.header) + 20, overlap=9)
    assert (second.row_start, second.row_end, second.mode, second.overlap) == (2, 3, ROWS_AND_HEADER, 9)
    assert parts(segment, len(segment.header) + 20, overlap=8)[1].mode == HEADER
    # one row a part leaves no room for another
    assert [p.overlap for p in parts(segment, len(segment.header) + 10, overlap=9)] == [0, 0, 0]


def test_a_long_row_is_cut_at_blanks():
    (segment,) = parse("| a |\n| --- |\n| " + "word " * 20 + "|")
    out = parts(segment, 40)
    assert all(p.flags == (ROW_SPLIT,) and p.row_start == p.row_end == 1 for p in out)
    assert "".join(p.text[len(segment.header) + 1 :] for p in out) == segment.rows[0]
    assert all(p.text.endswith(" ") for p in out[:-1])


def test_a_long_header_is_flattened():
    (segment,) = parse("| " + "x" * 100 + " |\n| --- |\n| 1 |")
    assert {p.flags for p in parts(segment, 60)} == {(HEADER_SPLIT, FLATTENED)}
    assert {p.flags for p in parts(segment, len(segment.header))} == {(HEADER_EXHAUSTED, FLATTENED)}
    with pytest.raises(ValueError):
        parts(segment, 10)


def test_an_empty_table_keeps_its_header():
    (segment,) = parse("| a |\n| --- |")
    assert [p.text for p in parts(segment, 50)] == ["| a |\n| --- |"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), max_size=12), st.integers(60, 120), st.integers(0, 40))
def test_parts_hold_the_limit_and_every_row(values, limit, overlap):
    rows = [f"| {v.strip()} |" for v in values]
    (segment,) = parse("\n".join(["| h |", "| --- |", *rows]))
    out = parts(segment, limit, overlap, "prefix")
    assert all(len("prefix\n\n" + p.text) <= limit for p in out)
    new = [p.text[len(segment.header) + 1 :][p.overlap + (p.overlap > 0) :] for p in out if p.row_start]
    assert "".join(new).replace("\n", "") == "".join(rows)
    assert all(p.overlap <= overlap for p in out)


@given(st.text("ab \n", min_size=1, max_size=300), st.integers(1, 50))
def test_pieces_rejoin(text, size):
    out = pieces(text, lambda t: len(t) <= size)
    assert "".join(out) == text and max(map(len, out)) <= size


def test_blocks_of_any_kind(spark):
    rows = [("a", "p", TABLE), ("b", None, None), ("c", "", ""), ("d", "p", "plain\ntext"), ("a", "p", TABLE), ("e", "p", "| " + "y" * 5000 + " |")]
    blocks = spark.createDataFrame(rows, "key string, prefix string, markdown string")
    out = chunked(blocks, 64, 10).toPandas()
    assert set(out["key"]) == set("abcde") and out["size"].max() <= 64
    assert (out["key"] == "a").sum() % 2 == 0
    assert chunked(blocks.limit(0)).count() == 0
