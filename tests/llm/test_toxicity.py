import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import toxicity


def brute(scores):
    """Maximal segments: the best of what is left, the shortest of equals, left and right of it again."""
    best = None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i : j + 1])
            if s > 1e-9 and (best is None or s > best[0] + 1e-9 or abs(s - best[0]) <= 1e-9 and j - i < best[2] - best[1]):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return [*brute(scores[:i]), (i, j, round(s, 6)), *[(a + j + 1, b + j + 1, v) for a, b, v in brute(scores[j + 1 :])]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([toxicity.DRIFT, -0.25, -1.75, 0.0, 0.25, 0.75, 1.125, 3.0]), max_size=14))
def test_segments_are_maximal(scores):
    got = [(s.first, s.last, round(s.score, 6)) for s in toxicity.segments(np.array(scores))]
    assert sorted(v for _, _, v in got) == sorted(v for _, _, v in brute(scores))


def test_learns_and_leaves_clean_texts(spark, odd, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(4))
    rows, marks = [], []
    for i in range(400):
        toxic = i % 8 == 0
        w = [word() for _ in range(60)]
        if toxic:
            w[10:10] = rng.choices(["vile", "scummy", "rotten"], k=3)
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (5, None, "x"), (None, 1, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    scored = toxicity.scored(docs, model).collect()
    held = [(r["score"], r["doc_id"] % 8 == 0) for r in scored if r["held_out"]]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.97
    spans = [r["passages"] for r in scored if r["doc_id"] == 0]
    assert spans and spans[0]
    out = toxicity.scored(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    flat = toxicity.train(empty, labels)
    assert toxicity.scored(empty, flat).count() == 0
    assert {r["predicted"] for r in toxicity.scored(odd, flat).collect()} == {0}
