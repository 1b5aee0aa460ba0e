"""Source inventory: identity by content, duplicate groups, canonical selection, collision guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def identified(files: DataFrame, content: str = "text") -> DataFrame:
    """Adds source_sha256 and source_id, the first 16 hex digits."""
    return files.withColumn("source_sha256", F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).withColumn("source_id", F.substring("source_sha256", 1, 16))


def duplicate_groups(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per content: source_id, duplicate_group_size, aliases (sorted), canonical (smallest path)."""
    return files.groupBy("source_id").agg(F.count("*").alias("duplicate_group_size"), F.min(F.lower(path)).alias("canonical"), F.sort_array(F.collect_list(path)).alias("aliases"))


def canonical(files: DataFrame, path: str = "path", policy: DataFrame | None = None) -> DataFrame:
    """One row per source_id: the policy's path where there is one, else the smallest path regardless of case.
    policy: source_id, preferred_path."""
    if policy is None:
        files = files.withColumn("preferred_path", F.lit(None).cast("string"))
    else:
        files = files.join(policy, "source_id", "left")
    order = W.partitionBy("source_id").orderBy(F.coalesce(F.col(path) != F.col("preferred_path"), F.lit(True)), F.lower(path), path)
    return files.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def unknown_policies(files: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy rows that no file meets; must be empty."""
    return policy.join(files, "source_id", "left_anti")


def id_collisions(files: DataFrame) -> DataFrame:
    """Shortened ids that stand for more than one content; must be empty."""
    return files.groupBy("source_id").agg(F.count_distinct("source_sha256").alias("n")).filter("n > 1")
