"""Filters of retrieval: metadata conditions, short chunks, lookups that miss, answerable questions, eligible rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens up to which a chunk is too short to be searched, and what a question's expected behaviour is called.
SHORT_TOKENS, ANSWER = 95, "answer"


def matching(conditions: Mapping[str, Any]) -> Column:
    """All conditions at once, for lexical and dense search alike: a plain value stands for equality, a mapping
    {"$in": values} for one of several. Null never matches; without conditions everything does. Scans get the
    conditions pushed down."""

    def one(name: str, wanted: Any) -> Column:
        if not isinstance(wanted, Mapping):
            return F.col(name) == F.lit(wanted)
        if set(wanted) != {"$in"}:
            raise ValueError(f"{name}: only equality and $in are known")
        return F.col(name).isin(list(wanted["$in"]))

    return reduce(Column.__and__, [F.coalesce(one(k, v), F.lit(False)) for k, v in conditions.items()], F.lit(True))


def long_enough(chunks: DataFrame, tokens: str = "token_count", most: int = SHORT_TOKENS) -> DataFrame:
    """Chunks of more than `most` tokens; a missing count is 0."""
    return chunks.filter(F.coalesce(F.col(tokens), F.lit(0)) > most)


def with_texts(hits: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """hits with their texts; a hit whose document is missing keeps its place with an empty text."""
    return hits.join(texts.select(key, text), key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def answerable(questions: DataFrame, behaviour: str, gold: str) -> DataFrame:
    """Questions that are to be answered and have gold ids."""
    return questions.filter((F.col(behaviour) == ANSWER) & (F.size(gold) > 0))


def eligible(flags: Sequence[str], text: str = "text") -> Column:
    """Each flag is true (null isn't) and the text is more than blanks."""
    flagged = [F.col(f).eqNullSafe(F.lit(True)) for f in flags]
    return reduce(Column.__and__, flagged, F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) != "", F.lit(False)))
