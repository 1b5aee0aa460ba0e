"""Ordered blocks: running sections, text streams (gaps and islands), spans, page markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import page_marker


def line_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_order (from 1), block_text: the lines of each document; blank ones aren't indexable."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "block_text"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("block_order"), "block_text", (F.trim("block_text") != "").alias("indexable"))


def running_section(blocks: DataFrame, heading: str, default: str, key: str = "doc_id") -> DataFrame:
    """Adds section_path: the last heading up to the block."""
    upto = W.partitionBy(key).orderBy("block_order").rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("section_path", F.coalesce(F.last(heading, ignorenulls=True).over(upto), F.lit(default)))


def text_streams(blocks: DataFrame, boundary: str, key: str = "doc_id") -> DataFrame:
    """Adds stream_no: indexable blocks are numbered by runs of equal `boundary`; others are left out."""
    order = W.partitionBy(key).orderBy("block_order")
    kept = blocks.filter("indexable")
    changed = F.coalesce((F.lag(boundary).over(order) != F.col(boundary)).cast("int"), F.lit(1))
    return kept.withColumn("changed", changed).withColumn("stream_no", F.sum("changed").over(order).cast("long")).drop("changed")


def char_spans(streams: DataFrame, separator: int = 2, key: str = "doc_id") -> DataFrame:
    """Adds char_start and char_end of each block in its stream's text, blocks being `separator` apart."""
    order = W.partitionBy(key, "stream_no").orderBy("block_order")
    size = F.length("block_text").cast("long")
    end = F.sum(size + separator).over(order) - separator
    return streams.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - size)


def trailing_page_markers(blocks: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """Adds is_page_marker: a marker counts only if all later blocks of its page are markers too."""
    marked = blocks.withColumn("marker", page_marker(F.col("block_text")).isNotNull())
    last_other = F.max(F.when(~F.col("marker"), F.col("block_order"))).over(W.partitionBy(key, page))
    return marked.withColumn("is_page_marker", F.col("marker") & (F.col("block_order") > F.coalesce(last_other, F.lit(0)))).drop("marker")


def block_range(streams: DataFrame, field: str, key: str = "doc_id") -> DataFrame:
    """First and last non-null value of a field in each stream."""
    pick = lambda f: f(F.when(F.col(field).isNotNull(), F.struct("block_order", F.col(field).alias("value"))))["value"]
    return streams.groupBy(key, "stream_no").agg(pick(F.min).alias(f"{field}_start"), pick(F.max).alias(f"{field}_end"), F.count("*").alias("n_blocks"))
