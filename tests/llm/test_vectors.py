import math
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import embdup, topk


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows, n = [], 0
    for i in range(300):
        v = base[i % 30] + rng.normal(size=16) * 0.08 * (i % 4)
        rows.append((n := n + 1, [float(x) for x in v.astype(np.float32)], i % 3))
    rows += [(400 + i, rows[5][1], 2) for i in range(40)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [None] + [1.0] * 15, 1), (503, [float("nan")] * 16, 1), (504, rows[0][1], None), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [], 1), (508, [float("inf")] * 16, 1), (None, rows[0][1], 0), (1, rows[0][1], 0)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, cell int"), rows


def components(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def usable(v, zero=False):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


@pytest.mark.parametrize(("tile", "bucket"), [(embdup.TILE, embdup.BUCKET), (16, 64), (embdup.TILE, 8)])
def test_links_and_components(vectors, tile, bucket, monkeypatch):
    monkeypatch.setattr(embdup, "TILE", tile)
    monkeypatch.setattr(embdup, "BUCKET", bucket)
    frame, rows = vectors
    fine = list({(i, tuple(v), l) for i, v, l in rows if i is not None and l is not None and usable(v)})
    links, count = set(), {}
    for x in range(len(fine)):
        for y in range(x):
            (i, a, l), (j, b, m) = fine[x], fine[y]
            if l == m and len(a) == len(b) and i != j and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.93:
                links |= {(i, j), (j, i)}
    for i, _ in links:
        count[i] = count.get(i, 0) + 1
    root = components({i for i, _, _ in rows if i is not None}, links)
    got = embdup.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_links"] == count.get(r["vec_id"], 0), r
        assert r["component_id"] == root.get(r["vec_id"])
        assert r["kept"] == (r["vec_id"] is None or r["vec_id"] == root[r["vec_id"]])


def test_recall_at_the_threshold_with_many_bits(spark, monkeypatch):
    """Pairs planted at 0.93 itself among 20,000 vectors, with ten bits and more than one table needed."""
    monkeypatch.setattr(embdup, "BUCKET", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(17_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = rng.choice(17_000, 1500, replace=False)
    side = rng.normal(size=(1500, 24))
    side -= (side * x[pairs]).sum(axis=1, keepdims=True) * x[pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.9301 * x[pairs] + math.sqrt(1 - 0.9301**2) * side
    rows = np.concatenate([x, near])
    bits, tables = embdup.tables_for(len(rows))
    assert bits >= 10 and tables > 10
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embdup.near_duplicates(frame).collect()}
    linked = [got[17_000 + i]["component_id"] == got[int(p)]["component_id"] for i, p in enumerate(pairs)]
    assert np.mean(linked) >= 0.995
    exact = rows @ rows.T >= 0.93
    count = exact.sum(axis=1) - 1
    assert all(got[i]["n_links"] <= count[i] for i in range(len(rows)))
    assert sum(r["n_links"] for r in got.values()) >= 0.995 * count.sum()


def whole(v: list[float]) -> list[int]:
    """floor(64 * x) in whole numbers, as far as doubles don't overflow."""
    return [math.floor(Fraction(float(x)) * 64) for x in v]


def best_others(rows: list[tuple[int, list[float]]], k: int = 20, step: int = 20) -> dict[int, list[tuple[int, int, int]]]:
    """rank, vec_id and score (as the nearest long) of each query's best, by brute force in whole numbers."""
    scaled = [(i, whole(v)) for i, v in rows if i is not None and usable(v, zero=True)]
    out = {}
    for i, x in scaled:
        if i % step == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in scaled if j != i and len(x) == len(y))[:k]
            out[i] = [(n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best)]
    return out


def found(frame) -> dict[int, list[tuple[int, int, int]]]:
    got = {}
    for r in topk.top_k(frame).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {i: sorted(v) for i, v in got.items()}


@pytest.mark.parametrize("queries", [topk.QUERIES, 3])
def test_exact_top_k(vectors, monkeypatch, queries):
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "PAGE", 8)
    monkeypatch.setattr(topk, "QUERIES", queries)
    frame, rows = vectors
    want = best_others([(i, v) for i, v, _ in rows])
    assert want and found(frame) == {i: v for i, v in want.items() if v}


@pytest.mark.parametrize("size", [1e3, 1e7, 1e8, 1e16, 1e300])
def test_top_k_of_large_parts(spark, monkeypatch, size):
    """Scores that doubles can't tell apart, and those beyond 64 bits; small vectors among them."""
    monkeypatch.setattr(topk, "CHUNK", 64)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * (size if i % 3 else 1)).tolist()) for i in range(150)]
    rows += [(200 + i, [size + i % 2, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(frame) == best_others(rows)


def test_top_k_of_many_equal_vectors(spark, monkeypatch):
    """A cell that no distance divides, ties among all of it, and more lengths than have trees."""
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "LENGTHS", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, rng.normal(size=3 + i % 4).tolist()) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(frame) == best_others(rows)


def test_the_directory_rules_chunks_out(spark, monkeypatch):
    """Vectors in far groups: a query isn't sent to chunks whose bound its k-th score beats."""
    monkeypatch.setattr(topk, "CHUNK", 100)
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(8, 5)) * 20
    middle *= 20 / np.linalg.norm(middle, axis=1, keepdims=True)
    rows = [(i, (middle[i % 8] + rng.normal(size=5) * 0.05).tolist()) for i in range(800)]
    sent = []
    search = topk.search
    monkeypatch.setattr(topk, "search", lambda rows, *a: sent.append(rows.count()) or search(rows, *a))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(frame) == best_others(rows)
    assert sent[0] == 40 and sent[1] < 40 * 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embdup.near_duplicates(none).count() == 0
    assert topk.top_k(none).count() == 0
