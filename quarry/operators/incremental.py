"""Resumable work: what is still to do, upserts, and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(keys).distinct(), keys, "left_anti")


def unexpected(done: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Done keys that aren't in the input; must be empty."""
    return done.select(keys).distinct().join(rows, keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows, and old ones whose key they don't have."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def to_search(queries: DataFrame, variants: DataFrame, log: DataFrame) -> DataFrame:
    """Query and variant pairs that the log lacks. Variants are a short fixed list."""
    return pending(queries.crossJoin(F.broadcast(variants)), log, ["query_id", "variant"])
