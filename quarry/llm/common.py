"""What the operators of this subpackage share: the shared folder, lineage cuts and row keys."""

from __future__ import annotations

import ctypes
import math
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import BROADCAST_BYTES, cut, fits, joined, shared_dir, ship, sized  # noqa: F401


def remove(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_hash(*columns: str, seed: int = 0) -> Column:
    """A seeded 64-bit hash of columns; nulls differ from empty texts."""
    parts = [F.lit(seed)]
    for c in columns:
        parts += [F.col(c), F.col(c).isNull()]
    return F.xxhash64(*parts)


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size is below BROADCAST_BYTES; else Spark shuffles it."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("shuffle_merge")


#: Rows that one task orders, where a whole table needs an order.
ORDERED_ROWS = 20_000


def running(df: DataFrame, rows: int, order: list[Column], sums: list[str]) -> DataFrame:
    """df, of `rows` rows, with rn (from 1) and, for each column c of sums, before_c: its sum over the rows before.

    Ranges of the order are dealt to tasks of about ORDERED_ROWS rows; only a row for each range meets in one task.
    """
    parts = max(1, math.ceil(rows / ORDERED_ROWS))
    if parts == 1:
        every = W.partitionBy().orderBy(*order)
        before = {f"before_{c}": F.coalesce(F.sum(c).over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for c in sums}
        return df.select("*", F.row_number().over(every).cast("long").alias("rn"), *[v.alias(c) for c, v in before.items()])
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    values = ["n", *[f"s{i}" for i in range(len(sums))]]
    totals = ranged.select("range", F.lit(1).cast("long").alias("n"), *[F.col(c).alias(v) for c, v in zip(sums, values[1:], strict=True)]).groupBy("range").agg(*[F.sum(v).alias(v) for v in values])
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"base_{v}") for v in values])
    within = W.partitionBy("range").orderBy(*order)
    numbered = ranged.withColumn("rn", F.row_number().over(within).cast("long"))
    for c in sums:
        numbered = numbered.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = numbered.join(F.broadcast(bases), "range")  # a row for each of the ranges
    return placed.select(*df.columns, (F.col("rn") + F.col("base_n")).alias("rn"), *[(F.col(f"before_{c}") + F.col(f"base_{v}")).alias(f"before_{c}") for c, v in zip(sums, values[1:], strict=True)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


_held: dict[str, Callable[[], None]] = {}


def holding(name: str, clear: Callable[[], None]) -> None:
    """In a Python worker: an operator that keeps a cache between tasks says so, and those of other operators
    that ran there before are emptied."""
    others = [n for n in _held if n != name]
    for other in others:
        _held.pop(other)()
    _held[name] = clear
    if others and sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; gives freed memory back
        if trim:
            trim(0)
