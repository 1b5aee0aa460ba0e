"""Retrieval metrics at k, soft matches, coverage, summaries and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.text import ngrams
from quarry.operators import matching
from quarry.session import cut, joined

#: GRAMS: n-grams of returned documents that go to all tasks at once, in soft().
SOFT, COVERED, GRAMS = 0.80, 0.6, 1 << 22


def at_k(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """ranked: query_id, rank, doc_id; gold: query_id, doc_id. query_id, k, hit, recall, precision, mrr, ndcg for
    each query with gold. Repeated documents count at their first rank alone."""
    once = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    order = W.partitionBy("query_id").orderBy("rank")
    once = once.withColumn("rank", F.row_number().over(order))
    n_gold = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    marked = once.join(gold.distinct().withColumn("is_gold", F.lit(1)), ["query_id", "doc_id"], "left").fillna(0, ["is_gold"])
    cells = n_gold.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).join(marked, "query_id", "left").withColumn("inside", F.col("rank") <= F.col("k"))
    hit = F.col("inside") & (F.col("is_gold") == 1)
    agg = cells.groupBy("query_id", "k", "n_gold").agg(F.count_if(hit).alias("hits"), F.count_if("inside").alias("returned"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", "k").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return agg.select("query_id", "k", F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"), F.round(F.col("hits") / F.col("n_gold"), 6).alias("recall"), F.round(F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0), 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def first_hit(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, first_rank: -1 where no gold document is returned."""
    hits = ranked.join(gold.distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").cast("long").alias("first_rank"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("first_rank", F.lit(-1).cast("long")).alias("first_rank"))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = SOFT) -> DataFrame:
    """left: a, grams; right: b, grams; both distinct. Pairs whose n-gram sets are similar enough. left is the side of
    stated queries, whose n-grams go to all tasks in blocks; right stays where it is."""
    asked = left.select("a", F.explode("grams").alias("term"))
    return matching.overlaps(right.select("b", F.col("grams").alias("terms")), asked, "b", "a", similar=threshold).select("a", "b", "similarity")


def soft(ranked: DataFrame, gold: DataFrame, texts: DataFrame, ks: list[int], threshold: float = SOFT, grams: Callable[[Column], Column] = ngrams) -> DataFrame:
    """query_id, k, hit_soft, recall_soft, added: returned documents count as gold too if their n-grams are similar
    enough to those of one of the query's gold documents. texts: doc_id, text. Copies of a gold document don't lift
    recall above 1; `added` is how many documents the query's list gains. Only a query's own documents are compared."""
    wanted, ranked = cut(gold.distinct(), "gold"), cut(ranked.select("query_id", "doc_id", "rank"), "ranked")
    pending = ranked.join(wanted.select("query_id").distinct(), "query_id", "left_semi").join(wanted, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id").distinct()
    more = cut(_similar(cut(pending, "pending"), wanted, texts, threshold, grams).distinct(), "more")
    n_gold = wanted.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    n_more = more.groupBy("query_id").agg(F.count("*").alias("added"))
    hits = ranked.join(wanted.unionByName(more), ["query_id", "doc_id"], "left_semi").select("query_id", "rank")
    per = n_gold.join(n_more, "query_id", "left").fillna(0, ["added"]).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    counted = per.join(hits, "query_id", "left").groupBy("query_id", "k", "n_gold", "added").agg(F.count_if(F.col("rank") <= F.col("k")).alias("hits"))
    return counted.select("query_id", "k", F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_soft"), F.round(F.least("hits", "n_gold") / F.col("n_gold"), 6).alias("recall_soft"), "added")


def _similar(pending: DataFrame, gold: DataFrame, texts: DataFrame, threshold: float, grams: Callable[[Column], Column]) -> DataFrame:
    """The pairs (query_id, doc_id) of pending for which a gold document of the query is similar enough; a pair may
    come from several tasks. A gold document's n-grams are made once for each block of queries, where its text is;
    those of a block's pending documents go to all tasks. A task compares a pair until it is found."""
    sets = cut(joined(texts.select("doc_id", "text"), cut(pending.select("doc_id").distinct(), "returned"), "doc_id").select("doc_id", grams(F.col("text")).alias("grams")), "grams")
    total = pending.join(sets.select("doc_id", F.size("grams").alias("n")), "doc_id").agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // GRAMS) or 1
    part = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    schema = T.StructType([pending.schema["query_id"], pending.schema["doc_id"]])
    return matching.union([_similar_block(pending.filter(part == i), gold.filter(part == i), texts, sets, threshold, grams, schema) for i in range(n_blocks)])


def _similar_block(pending: DataFrame, gold: DataFrame, texts: DataFrame, sets: DataFrame, threshold: float, grams: Callable[[Column], Column], schema: T.StructType) -> DataFrame:
    out = to_arrow_schema(schema)
    table = sets.join(pending.select("doc_id").distinct(), "doc_id").toArrow()
    lists = table["grams"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    terms, ids = coded.dictionary, coded.indices.to_numpy()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    place = {doc: i for i, doc in enumerate(table["doc_id"].to_pylist())}
    names = list(place)
    asked: dict = {}
    for r in pending.collect():
        if r["doc_id"] in place:
            asked.setdefault(r["query_id"], []).append(place[r["doc_id"]])

    def scan(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(max(1, len(terms)), bool)
        left = {q: list(docs) for q, docs in asked.items()}
        for batch in incoming:
            sizes = pc.fill_null(pc.list_value_length(batch["grams"]), 0).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(batch["grams"].flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            until = np.cumsum(sizes)
            found = []
            for queries, n, end in zip(batch["queries"].to_pylist(), sizes.tolist(), until.tolist(), strict=True):
                todo = {d for q in queries for d in left.get(q, ())}
                if not n or not todo:
                    continue
                own = at[end - n : end]
                own = own[own >= 0]
                there[own] = True
                near = set()
                for d in todo:
                    start = int(ends[d - 1]) if d else 0
                    m = int(ends[d]) - start
                    if m and min(n, m) / max(n, m) >= threshold:
                        both = int(np.count_nonzero(there[ids[start : start + m]]))
                        if both / (n + m - both) >= threshold:
                            near.add(d)
                there[own] = False
                if near:
                    for q in queries:
                        found += [(q, d) for d in left.get(q, ()) if d in near]
                        if q in left:
                            left[q] = [d for d in left[q] if d not in near]
            if found:
                yield from matching.batches([pa.array([q for q, _ in found], out[0].type), pa.array([names[d] for _, d in found], out[1].type)], out)

    by_doc = cut(gold.groupBy("doc_id").agg(F.collect_list("query_id").alias("queries")), "gold-docs")
    return joined(texts.select("doc_id", "text"), by_doc, "doc_id").select("queries", grams(F.col("text")).alias("grams")).mapInArrow(scan, schema)


def wide(scores: DataFrame, key: str, ks: list[int], names: list[str]) -> DataFrame:
    """One row for each key, with a column `name_at_k` for each measure and k: one aggregation, the ks being known."""
    cells = [F.max(F.when(F.col("k") == k, F.col(n))).alias(f"{n}_at_{k}") for n in names for k in ks]
    return scores.groupBy(key).agg(*cells)


def by_gold_count(scores: DataFrame, gold: DataFrame, *by: str) -> DataFrame:
    """*by, n_gold, n, recall (mean): whether queries with many gold documents do worse."""
    n_gold = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return scores.join(n_gold, "query_id").groupBy(*by, "n_gold").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 5).alias("recall"))


def coverage(gold: DataFrame, returned: DataFrame) -> DataFrame:
    """gold: query_id, gold_no, grams; returned: query_id, grams (of the first k). query_id, coverage (mean share of a
    gold text's n-grams that are returned), any_covered, all_covered. A gold text without n-grams has coverage 0."""
    # outer, though null matches nothing: from a plain explode Spark infers a filter, and puts it below a join, where it
    # makes the n-grams of every text
    pool = returned.select("query_id", F.explode_outer("grams").alias("g")).distinct().withColumn("there", F.lit(1))
    parts = gold.select("query_id", "gold_no", F.explode_outer("grams").alias("g")).join(pool, ["query_id", "g"], "left")
    each = parts.groupBy("query_id", "gold_no").agg((F.coalesce(F.sum("there"), F.lit(0)) / F.greatest(F.lit(1), F.count("g"))).alias("share"))
    return each.groupBy("query_id").agg(F.round(F.avg("share"), 6).alias("coverage"), F.when(F.max("share") >= COVERED, 1.0).otherwise(0.0).alias("any_covered"), F.when(F.min("share") >= COVERED, 1.0).otherwise(0.0).alias("all_covered"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; an append-only log is read like that."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("rn = 1").drop("rn")


def stratified(rows: DataFrame, level: str, limit: int, order: Column) -> DataFrame:
    """greatest(1, round(limit * n_level / n)) rows of each level, halves to even, in the given order."""
    per = rows.groupBy(level).agg(F.count("*").alias("n_level"))
    total = per.agg(F.sum("n_level").alias("n_all"))
    share = F.greatest(F.lit(1), F.bround(F.lit(limit) * F.col("n_level") / F.col("n_all")).cast("long"))
    quota = per.crossJoin(F.broadcast(total)).select(level, share.alias("quota"))
    numbered = rows.withColumn("rn", F.row_number().over(W.partitionBy(level).orderBy(order)))
    return numbered.join(quota, level).filter(F.col("rn") <= F.col("quota")).drop("rn", "quota")
