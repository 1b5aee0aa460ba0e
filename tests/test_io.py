import pytest
from pyspark.sql import functions as F

from quarry.operators import incremental, inventory, quality
from quarry.sources import io
from quarry.streaming import append


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "é\n")], "id int, t string")
    io.write_jsonl(rows, str(tmp_path / "x"), gzip=True, sort=["id"])
    again = io.jsonl(spark, str(tmp_path / "x"), rows.schema)
    assert io.content_hash(again).first() == io.content_hash(rows).first()


def test_bad_json_is_an_error(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{"id": \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        io.jsonl(spark, str(tmp_path / "bad.jsonl"), "id int").collect()


def test_file_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"one")
    (tmp_path / "y.hwp").write_bytes(b"one")
    (tmp_path / "z.txt").write_bytes(b"two")
    found = io.files(spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in found) == ["x.PDF", "y.hwp"]
    assert len({r["source_sha256"] for r in found}) == 1
    raw = spark.read.format("binaryFile").load(str(tmp_path / "y.hwp"))
    parsed = io.parsed(raw, lambda content, path: [{"n": len(content)}], io.T.StructType([io.T.StructField("n", io.T.LongType())]))
    assert parsed.first()["n"] == 3


def test_json_array_and_csv(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"question": "a"}, {"question": " "}, {}]')
    assert io.json_array(spark, str(tmp_path / "q.json"), "question string", "question").count() == 1
    io.write_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 3


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, incremental.upserted(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["id"] for r in incremental.pending(new, old, ["id"]).collect()] == [3]


def test_stream_appends_each_key_once(spark, tmp_path):
    src, log, check = (str(tmp_path / x) for x in ("src", "log", "check"))
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    rows.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(src)
        append.append_new(stream, ["id"], log, check).awaitTermination()
        rows.write.mode("append").parquet(src)
    assert sorted(r["id"] for r in spark.read.parquet(log).collect()) == [1, 2]


def test_guards(spark):
    files = spark.createDataFrame([("p/B", "x"), ("p/a", "x"), ("q", None)], "path string, text string")
    known = inventory.identified(files)
    assert {r["path"] for r in inventory.canonical(known).collect()} == {"p/a", "q"}
    policy = known.filter("path = 'p/B'").select("source_id", F.lit("p/B").alias("preferred_path"))
    assert {r["path"] for r in inventory.canonical(known, policy=policy).collect()} == {"p/B", "q"}
    assert inventory.unknown_policies(known, spark.createDataFrame([("zz", "p")], "source_id string, preferred_path string")).count() == 1
    assert quality.violations(files, n_null=F.col("text") == "x").first()["n_null"] == 1
