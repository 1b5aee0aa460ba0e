"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole records, with all their columns, uniformly into memory-sized buckets by a seeded hash.
Pass 2 shuffles each bucket by Fisher-Yates and deals the global order, bucket after bucket, over the shards in
turn, so that the shards' counts are at most one apart (law `rows`) and slots are gapless. Records are written to
one folder per shard, in the order of slots within a file.

Records that are equal in all columns have one hash; where they are more than a share of a bucket, they are
counted before they are scattered, in pieces of a bounded size, and become records again in their buckets. So no
group of copies, a third of all rows, say, meets in one bucket.

Defined results: a null text has size 8 and the crc32 of an empty text; groups of equal texts are dealt like other
records, over all shards (a shard that kept them together would break the law); records equal in all columns are
interchangeable; an empty table gives no files; all other columns travel along, except those named like a column
that is added (size, shard, slot), which are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import cut, joined, row_hash, running, shared_dir

#: Bytes of records of a bucket, which one task holds in memory; equal records of over a SHARE-th of that are counted.
BUCKET_BYTES, SHARE = 16 << 20, 16
ADDED = ("size", "shard", "slot")


def byte_size(fields: list[T.StructField], text: str) -> tuple[Column, Column]:
    """The contract's size, and the bytes that a record takes in memory."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    rest = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in fields if isinstance(f.dataType, (T.StringType, T.BinaryType)) and f.name != text]
    return size, sum(rest, size + 8 * len(fields))


def shard(docs: DataFrame, n_shards: int, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records with their columns, size, shard and slot, shuffled."""
    names = [c for c in docs.columns if c not in ADDED]
    own = [f"c{i}" for i in range(len(names))]
    records = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)])
    text, fields = own[names.index("text")], records.schema.fields
    size, width = byte_size(fields, text)
    records = records.withColumn("size", size).withColumn("width", width).withColumn("h", row_hash(*own, seed=seed))
    total = records.agg(F.sum("width")).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    limit = max(1, bucket_bytes // SHARE)
    heavy = cut(records.groupBy("h").agg(F.sum("width").alias("bytes"), F.max("width").alias("most")).filter((F.col("bytes") > limit) & (F.col("bytes") > F.col("most"))).select("h", "most"), "shard-heavy")
    bucket = lambda *h: F.pmod(F.xxhash64(*h), F.lit(n_buckets))
    scattered = records.withColumn("copies", F.lit(1).cast("long")).withColumn("bucket", bucket("h"))
    if not heavy.isEmpty():
        each = F.greatest(F.lit(1), F.lit(limit) / F.col("width")).cast("long")
        groups = joined(records, heavy.select("h"), "h", "left_semi").groupBy(*own, "size", "width", "h").agg(F.count("*").alias("n"))
        parts = groups.withColumn("each", each).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div each"))))
        parts = parts.withColumn("copies", F.least(F.col("each"), F.col("n") - F.col("piece") * F.col("each"))).withColumn("bucket", bucket("h", "piece"))
        columns = [*own, "size", "h", "copies", "bucket"]
        scattered = joined(scattered, heavy.select("h"), "h", "left_anti").select(columns).unionByName(parts.select(columns))
    counts = cut(scattered.groupBy("bucket").agg(F.sum("copies").alias("n")), "shard-counts")
    # one row per bucket, in ranges
    offsets = cut(running(counts, n_buckets, [F.col("bucket")], ["n"]).select("bucket", F.col("before_n").alias("offset")), "shard-offsets")
    placed = joined(scattered.select(*own, "size", "h", "copies", "bucket"), offsets, "bucket")

    def fisher_yates(table: pa.Table) -> pa.Table:
        bucket, first = table["bucket"][0].as_py(), table["offset"][0].as_py()
        # the input order of a bucket depends on the run; a total order of its records doesn't
        order = np.lexsort((table["copies"].to_numpy(), table["h"].to_numpy()))
        order = np.repeat(order, table["copies"].to_numpy()[order])
        random = np.random.default_rng([seed, bucket])
        random.shuffle(order)
        place = first + np.arange(len(order))
        out = table.select([*own, "size"]).take(pa.array(order))
        return out.append_column("shard", pa.array(place % n_shards, pa.int32())).append_column("slot", pa.array(place // n_shards, pa.int64()))

    schema = T.StructType([*fields, T.StructField("size", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return placed.groupBy("bucket").applyInArrow(fisher_yates, schema).toDF(*names, *ADDED)


def write_shards(docs: DataFrame, n_shards: int, path: str, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards as Parquet in path/shard=N and return what was written."""
    done = shard(docs, n_shards, seed, bucket_bytes)
    done.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(done.schema).parquet(path).select(*[F.col(f"`{c}`") for c in done.columns])


def default_path(docs: DataFrame) -> str:
    import uuid

    return f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"


def digest(written: DataFrame) -> DataFrame:
    """A row for each written record, without its text."""
    return written.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
