"""Weighted rank fusion, re-ranking with a pluggable scorer, and the columns of a search hit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONSTANT, WEIGHTS = 60, (0.7, 0.3)


def fused(lexical: DataFrame, dense: DataFrame, k: int, weights: tuple[float, float] = WEIGHTS, constant: int = CONSTANT) -> DataFrame:
    """query_id, rank, doc_id, score: sum of weight / (constant + rank) over both ranked lists. A document in one
    list only gets nothing from the other."""
    a = lexical.select("query_id", "doc_id", F.col("rank").alias("a_rank"))
    b = dense.select("query_id", "doc_id", F.col("rank").alias("b_rank"))
    share = lambda w, c: F.coalesce(F.lit(w) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round(share(weights[0], "a_rank") + share(weights[1], "b_rank"), 9))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score", "a_rank", "b_rank")


def reranked(candidates: DataFrame, scorer: Callable[[Column, Column], Column], query: str, passage: str, k: int) -> DataFrame:
    """The k best candidates by scorer(query, passage); equal scores keep the order of `rank`."""
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    rows = candidates.withColumn("rerank_score", F.round(scorer(F.col(query), F.col(passage)), 6))
    return rows.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k)


def shared_terms(tokenize: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """The default scorer: which share of the query's distinct terms the passage has."""

    def score(query: Column, passage: Column) -> Column:
        terms = F.array_distinct(tokenize(query))
        return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, tokenize(passage))) / F.size(terms))

    return score


def hit_text(text: Column, table_html: Column) -> Column:
    """A table's HTML where there is one, else the text, else nothing."""
    return F.coalesce(F.nullif(table_html, F.lit("")), text, F.lit(""))
