import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe
from quarry.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_rows_equal_the_library(odd, plain, library):
    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(odd, vocabulary(), with_ids=False).collect())
    assert got == Counter((i, *expected(t)) for i, t, _ in plain)


def test_ids_decode_to_what_they_say(odd):
    encoder = bpe.load(vocabulary())
    for r in bpe.encode(odd, vocabulary()).collect():
        assert encoder.decode(r["ids"]) == r["decoded"]
        assert len(r["ids"]) == r["n_tokens"]


def test_empty_table(empty):
    assert bpe.encode(empty, vocabulary()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert bpe.load(vocabulary()).encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>a<|startoftext|> b", "don't I'LL 's", "\x85x\xa0y\x1cz", "İ ſ K ΑΣ", "a" * 3000 + "!" * 500])
def test_edges(text, library):
    assert bpe.load(vocabulary()).encode(text) == library.encode(text, add_special_tokens=False).ids
