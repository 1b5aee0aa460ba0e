import random

import numpy as np

from quarry.llm import minhash
from tests.llm.conftest import words
from tests.llm.test_vectors import components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and a != b and 100 * len(s & t) >= 85 * len(s | t)]
    return components({i for i, _ in rows if i is not None}, links)


def check(frame, rows):
    root = brute(rows)
    got = minhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((str(i), len(shingle_set(t))) for i, t in rows)
    for r in got:
        assert r["component_id"] == root.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == root[r["doc_id"]])


def test_odd_rows(odd, plain):
    check(odd, [(i, t) for i, t, _ in plain])


def test_near_copies_in_tiles(spark, monkeypatch):
    """A group of near copies of all degrees, with buckets cut into small blocks."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(2)
    base = words(rng, 150).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_overlaps():
    sets = [minhash.shingles(t) for t in ("a b c d e f", "b c d e f g", "x y z x y z", "a b c d e f g")]
    assert minhash.overlaps(sets)[0, 1] == 1 and minhash.overlaps(sets)[0, 3] == 2 and minhash.overlaps(sets)[0, 2] == 0


def test_stage_keeps_one_of_each_group(odd, empty):
    kept = minhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    ids = [i for i, _ in rows if i is not None]
    assert len(ids) == len(set(ids))
    assert {5, 7} <= set(ids) and {4, 6, 8, 9, 10}.isdisjoint(ids)
    assert minhash.without_near_duplicates(empty).count() == 0


def test_a_large_group_and_a_few_others_in_one_bucket(spark, monkeypatch):
    """Members of the largest component meet only the blocks of other members."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(12)
    base = words(rng, 200).split()
    rows = []
    for i in range(200):  # near the base, all alike
        w = list(base)
        w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    for i in range(40):  # further away, each in its own direction
        w = list(base)
        for _ in range(3 + i % 4):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((1000 + i, " ".join(w)))
    seen, tiles = [], minhash.tile_links
    monkeypatch.setattr(minhash, "tile_links", lambda r, *a: seen.append(r.count()) or tiles(r, *a))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert seen[0] > 0


def test_stage_with_columns_of_any_name(spark):
    rows = [(1, "one two three four five six seven", 3, "x"), (1, "one two three four five six seven", 3, "x"), (1, None, 4, "y"), (2, "one two three four five six seven", 5, "z"), (3, "b", 6, None), (3, "a", 7, "w"), (None, "c", 8, "v"), (None, "c", 8, "v")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, id int, `__id.x` string")
    out = minhash.without_near_duplicates(frame)
    assert out.columns == frame.columns
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted([rows[2], rows[5], rows[6], rows[7]], key=str)
