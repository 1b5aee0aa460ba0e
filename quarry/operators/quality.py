"""Data-quality gates: each is a count of violations, all of a table in one aggregation where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """One row: for each rule, how many rows don't meet it. Null counts as not met."""
    return rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def contiguity(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, n_rows, contiguous: whether `order` runs from 1 without gaps or repeats."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), ((F.min(order) == 1) & (F.max(order) == F.count("*")) & (F.count_distinct(order) == F.count("*"))).alias("contiguous"))


def unique(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: n_rows, n_distinct and n_repeated keys."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_repeated"))


def orphans(rows: DataFrame, parents: DataFrame, column: str, parent: str) -> DataFrame:
    """Rows whose reference has no parent; a null reference is one too."""
    return rows.join(parents.select(F.col(parent).alias("__parent")), F.col(column) == F.col("__parent"), "left_anti")


def tiling(spans: DataFrame, key: str) -> DataFrame:
    """key, tiles: whether spans in order follow on one another from 0."""
    order = W.partitionBy(key).orderBy("char_start", "char_end")
    fits = F.col("char_start") == F.coalesce(F.lag("char_end").over(order), F.lit(0))
    return spans.withColumn("fits", fits).groupBy(key).agg(F.bool_and("fits").alias("tiles"), F.max("char_end").alias("covered"))


def singletons(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of distinct values of each column that must have one."""
    return rows.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """side ('left' or 'right') and value of what only one side has."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    only = lambda x, y, side: x.join(y, column, "left_anti").select(F.lit(side).alias("side"), F.col(column).alias("value"))
    return only(a, b, "left").unionByName(only(b, a, "right"))
