"""Sources and sinks: files, JSON Lines, JSON arrays, CSV, Parquet indexes, and pluggable parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The document formats of the inventory.
SUFFIXES = ("hwp", "hwpx", "pdf")


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, content: bool = True) -> DataFrame:
    """path, name, file_type, size, source_sha256 of all files below path with a wanted suffix; hidden parts of a path
    are left out. Without content nothing but the listing is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "false").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    listed = rows.withColumn("name", name).withColumn("file_type", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    kept = listed.filter(F.col("file_type").isin(*suffixes) & ~F.rlike("path", F.lit(r"/\.")))
    columns = ["path", "name", "file_type", F.col("length").alias("size")]
    return kept.select(*columns, F.sha2("content", 256).alias("source_sha256")) if content else kept.select(*columns)


def parsed(sources: DataFrame, parser: Callable[[bytes, str], list[dict]], schema: T.StructType) -> DataFrame:
    """Rows of a pluggable parser over (content, path), a batch of files at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, path in zip(batch["content"], batch["path"], strict=True):
                yield pd.DataFrame(parser(bytes(content), path), columns=schema.names)

    return sources.select("content", "path").mapInPandas(run, schema)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines, also gzipped: blank lines are skipped, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str, required: str | None = None) -> DataFrame:
    """A JSON file with one array; rows with a blank `required` field are left out."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows if required is None else rows.filter(F.trim(F.coalesce(F.col(required), F.lit(""))) != "")


def write_jsonl(rows: DataFrame, path: str, gzip: bool = False, sort: list[str] | None = None) -> None:
    """JSON Lines without null fields; with `sort`, in a stable order within and across files."""
    ordered = rows.orderBy(*sort) if sort else rows
    ordered.write.option("compression", "gzip" if gzip else "none").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").option("quoteAll", "true").csv(path)


def content_hash(rows: DataFrame) -> DataFrame:
    """One row: n_rows and a hash of the rows regardless of their order, to compare two writes."""
    return rows.select(F.xxhash64(*[F.to_json(F.struct(*rows.columns))]).alias("h")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("hash"))


def write_index(rows: DataFrame, path: str, bucket: str, buckets: int) -> None:
    """Parquet in folders of bucket numbers, so that a lookup by key reads one folder."""
    rows.withColumn("part", F.pmod(F.xxhash64(bucket), F.lit(buckets))).repartition(buckets, "part").write.partitionBy("part").parquet(path)
