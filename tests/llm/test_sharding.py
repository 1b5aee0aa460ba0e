import zlib
from collections import Counter, defaultdict

from quarry.llm import sharding


def test_law_slots_and_digests(odd, plain, tmp_path):
    rows = sharding.digest(sharding.write_shards(odd, 5, str(tmp_path / "s"), bucket_bytes=20_000)).collect()
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in plain)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_reruns_agree_and_seeds_differ(odd):
    run = lambda seed, frame: sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in sharding.shard(frame, 5, seed, 20_000).collect())
    assert run(1, odd) == run(1, odd.repartition(3))
    assert run(1, odd) != run(2, odd)


def test_empty_table(empty, tmp_path):
    assert sharding.digest(sharding.write_shards(empty, 24, str(tmp_path / "e"))).count() == 0


def test_other_columns_travel_along(odd, tmp_path):
    written = sharding.write_shards(odd.drop(odd["`a.b`"]), 3, str(tmp_path / "o"), bucket_bytes=20_000)
    assert written.columns == ["doc_id", "text", "lang", "source", "n_chars", "bucket", "kept", "size", "shard", "slot"]
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], r["bucket"], r["kept"])
    assert Counter(map(key, written.collect())) == Counter(map(key, odd.collect()))
    assert sharding.shard(odd, 3).columns[-4:] == ["a.b", "size", "shard", "slot"]


def test_equal_rows_and_equal_texts_are_spread(spark):
    """A third of all rows is one row, another third one text: neither meets in one bucket or shard."""
    rows = [(1, "the same " * 30, "a")] * 2000 + [(10 + i, "one text " * 30, "b") for i in range(2000)] + [(9000 + i, f"text {i}", None) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    buckets, run = [], sharding.running
    try:
        sharding.running = lambda df, *a: buckets.append(sorted(r["n"] for r in df.collect())) or run(df, *a)
        got = sharding.shard(frame, 7, bucket_bytes=64_000).collect()
    finally:
        sharding.running = run
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert max(buckets[0]) < 1200 and len(buckets[0]) > 10
    for of in ("the same ", "one text "):
        assert len({r["shard"] for r in got if r["text"].startswith(of)}) == 7
