"""Packing against literal expectations."""

from quarry.operators.chunking import pack


def sizes(chunks):
    return [c.size for c in chunks]


def ends(chunks):
    return [c.last + 1 for c in chunks]


def test_semantic_cut():
    assert ends(pack([300] * 4, 1024, minimum=256)) == [3, 4]
    assert ends(pack([300] * 4, 1024, cuts=frozenset({1}), minimum=256)) == [2, 4]


def test_cut_below_minimum_is_skipped():
    chunks = pack([100, 300, 300, 300], 1024, cuts=frozenset({0, 2}), minimum=256)
    assert ends(chunks) == [3, 4]
    assert sizes(chunks) == [700, 300]


def test_short_tail_blocks_cut():
    assert ends(pack([300, 300, 100], 1024, cuts=frozenset({1}), minimum=256)) == [3]


def test_limit_holds_without_cuts():
    assert sizes(pack([600, 600], 1024, minimum=256)) == [600, 600]


def test_whole_sentence_overlap():
    chunks = pack([461, 51, 461], 512, 51)
    assert sizes(chunks) == [512, 512]
    assert chunks[1].overlap == 51
    assert pack([460, 40, 460], 512, 51)[1].overlap == 40


def test_tail_leans_on_overlap():
    last = pack([460, 40, 20], 512, 51, 51)[-1]
    assert (last.mode, last.size - last.overlap, last.overlap) == ("existing_overlap_context", 20, 40)


def test_token_slice_overlap():
    chunks = pack([500, 20], 512, 51, 51)
    assert sizes(chunks) == [500, 71]
    assert (chunks[1].overlap, chunks[1].mode) == (51, "existing_overlap_context")


def test_tail_rebalance():
    chunks = pack([300, 210, 10], 512, 0, 51)
    assert sizes(chunks) == [300, 220]
    assert chunks[-1].mode == "whole_sentence_rebalance"


def test_tail_at_minimum_stays():
    assert sizes(pack([500, 51], 512, 51, 51)) == [500, 102]
    assert sizes(pack([20], 512, 51, 51)) == [20]


def test_oversized_sentence():
    chunks = pack([1100], 512, 51)
    assert len(chunks) == 3
    assert all(c.size <= 512 for c in chunks)
    assert [c.offset + c.size for c in chunks][-1] == 1100
    assert all(a.offset + a.size - b.offset == 51 for a, b in zip(chunks, chunks[1:], strict=False))


def test_no_sentences():
    assert pack([], 512, 51) == []
