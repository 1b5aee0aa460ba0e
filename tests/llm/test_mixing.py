import re
from collections import Counter, defaultdict

from quarry.llm import common, mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, cap=3.0):
    """Water filling by rounds: whatever is above its cap is set there, and the rest shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_takes(odd, plain):
    rows = mixing.taken(odd).collect()
    sizes = defaultdict(int)
    for _, text, source in plain:
        sizes[source] += size(text)
    want, took = targets(sizes), Counter()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, size(t)) for i, t, _ in plain)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(odd).collect()))


def test_capped_sources(spark):
    rows = [(i, "w " * 100, "a") for i in range(50)] + [(99, "x y", "b"), (100, "z", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {r["source"]: r for r in mixing.taken(frame).collect()}
    assert by["b"]["target"] == 6 and by["b"]["taken"] == 6
    assert by[None]["target"] == 3 and by[None]["taken"] == 3


def test_schedule_is_even_and_exact(spark):
    quotas = spark.createDataFrame([("a", 10, 0), ("b", 20, 10), (None, 30, 30)], "src string, quota long, base long")
    rows = sorted(mixing.schedule(quotas, 60).collect())
    by = defaultdict(list)
    for r in rows:
        by[r["src"]].append(r["block"])
    assert {s: v for s, v in by.items()} == {"a": list(range(10)), "b": list(range(20)), None: list(range(30))}
    for end in range(6, 61, 6):
        seen = Counter(r["src"] for r in rows[:end])
        assert all(abs(seen[s] - end * q / 60) <= 3 for s, q in (("a", 10), ("b", 20), (None, 30)))


def test_whole_documents(odd):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    known = Counter((r["doc_id"], r["text"]) for r in odd.collect())
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert set(got) <= set(known)
    assert all(n <= 3 * known[k] for k, n in got.items())


def test_empty_table(empty):
    assert mixing.taken(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_repeated_rows_in_numbers(spark, monkeypatch):
    """A third of all rows is one row: every one of them is told apart, and the takes stay near the targets."""
    monkeypatch.setattr(mixing, "COPIES", 64)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 32)
    monkeypatch.setattr(mixing, "STRETCH", 4)
    monkeypatch.setattr(common, "ORDERED_ROWS", 3)
    rows = [(1, "a b c", "s0")] * 400 + [(10 + i, "w " * (i % 9), f"s{i % 7}") for i in range(800)] + [(None, None, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, took = defaultdict(int), Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    want = targets(sizes)
    got = mixing.taken(frame).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(frame.repartition(3)).collect()))


def test_whole_documents_come_near_their_targets(spark):
    """The pipeline's stage: words of whole copies, by source, within a few documents of the target."""
    rows = [(i, "w " * (20 + i % 30), f"s{i % 4 if i % 3 else 0}") for i in range(3000)] + [(5000, "x " * 25, "s1")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, took = defaultdict(int), Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    for r in mixing.mixed_documents(frame).collect():
        took[r["source"]] += size(r["text"])
    for s, want in targets(sizes).items():
        assert abs(took[s] - want) <= 0.02 * want + 50, (s, took[s], want)
