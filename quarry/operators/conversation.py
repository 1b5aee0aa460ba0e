"""Conversation state: history windows, rewriting rules, hit deduplication, prompt context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that refer to what was said before, and the length from which a question stands alone.
REFERRING = "그거|그것|위|이전|해당|그럼|그러면"
ALONE = 20


def history(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds n_history and history: the n messages before each turn as `role: text` lines."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    said = F.collect_list(F.concat_ws(": ", "role", "text")).over(before)
    return turns.withColumn("n_history", F.size(said).cast("long")).withColumn("history", F.array_join(said, "\n"))


def rewrite_skippable(question: Column, n_history: Column, referring: str = REFERRING, alone: int = ALONE) -> Column:
    """A question needs no rewriting if it is blank, comes first, or is long without a referring word."""
    q = F.trim(F.coalesce(question, F.lit("")))
    refers = F.rlike(q, F.lit(rf"(?U)\b(?:{referring})\b"))
    return (q == "") | (n_history == 0) | ((F.length(q) >= alone) & ~refers)


def deduplicated_hits(hits: DataFrame, key: str, order: str, ident: str, text: str, limit: int = 5) -> DataFrame:
    """The first `limit` hits whose id and text weren't among the hits kept before; blanks are never equal. What
    is kept depends on what was, so each query's short list is folded."""
    columns = hits.columns

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        seen: set[tuple[str, str]] = set()
        kept = []
        for i, row in enumerate(rows.sort_values(order, kind="stable").to_dict("records")):
            marks = {(c, str(row[c]).strip()) for c in (ident, text) if row[c] is not None and str(row[c]).strip()}
            if not marks & seen:
                seen |= marks
                kept.append(i)
        return rows.sort_values(order, kind="stable").iloc[kept[:limit]][columns]

    return hits.groupBy(key).applyInPandas(fold, hits.schema)


def context(hits: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """key, context: numbered blocks of `field: value` lines, '-' for what is missing."""
    block = F.array_join(F.array(*[F.concat(F.lit(f"{f}: "), F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit("-"))) for f in fields]), "\n")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), block.alias("block"))))
    numbered = F.transform(listed, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), h["block"]))
    return hits.groupBy(key).agg(F.array_join(numbered, "\n\n").alias("context"))
