"""Dense retrieval: normalised vectors, adjacent distances, nearest neighbours, maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators import matching

#: Query vectors of a block.
QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """In double precision; a zero vector stays."""
    d = v.cast("array<double>")
    norm = F.sqrt(dot(d, d))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def adjacent_distances(vectors: DataFrame, stream: str, order: str) -> DataFrame:
    """stream, left_id, right_id, distance (6 decimals): cosine distance of neighbours within each stream."""
    w = W.partitionBy(stream).orderBy(order)
    rows = vectors.select(stream, order, unit(F.col("embedding")).alias("v"))
    paired = rows.withColumn("right_id", F.lead(order).over(w)).withColumn("next", F.lead("v").over(w)).filter("right_id is not null")
    return paired.select(stream, F.col(order).alias("left_id"), "right_id", F.round(1 - dot(F.col("v"), F.col("next")), 6).alias("distance"))


def scored(queries: DataFrame, corpus: DataFrame, on: list[str] | None = None) -> DataFrame:
    """queries: query_id, q; corpus: vec_id, v and filter columns, both unit vectors. Every query is scored
    against every vector that agrees in `on`. The stated queries are the small side; the corpus isn't moved
    where Spark can broadcast them."""
    pairs = queries.join(corpus, on) if on else queries.crossJoin(corpus)
    return pairs.withColumn("score", F.round(dot(F.col("q"), F.col("v")), 6))


def best(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score as of scored(), but only each task's k best of a query leave it, which are all that
    nearest(pairs, k) needs. Queries go to all tasks in blocks; vectors stay where they are."""
    schema = T.StructType([queries.schema["query_id"], corpus.schema["vec_id"], T.StructField("score", T.DoubleType())])
    out, rows = to_arrow_schema(schema), corpus.select("vec_id", "v")

    def against(block: DataFrame) -> DataFrame:
        table = block.select("query_id", "q").toArrow()
        asked, q = table["query_id"].combine_chunks(), table["q"].to_pylist()

        def scan(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = matching.Best(len(asked), k)
            # one matrix for each length of query vectors; null vectors and components score null
            whole = [x is not None and None not in x for x in q]
            groups = [(n, np.array([i for i, x in enumerate(q) if whole[i] and len(x) == n])) for n in {len(x) for i, x in enumerate(q) if whole[i]}]
            for batch in incoming:
                ids, v = matching.values(batch["vec_id"]), batch["v"]
                sizes = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
                if v.flatten().null_count:
                    holed = np.array([x is not None and None in x for x in v.to_pylist()])
                    sizes = np.where(holed, -1, sizes)
                scored_rows = np.zeros((len(asked), len(ids)), bool)
                for n, at in groups:
                    some = np.flatnonzero(sizes == n)
                    if len(some):
                        m = v.take(pa.array(some)).flatten().to_numpy().reshape(len(some), n)
                        for i in range(0, len(at), max(1, matching.CELLS // len(some))):
                            part = at[i : i + max(1, matching.CELLS // len(some))]
                            score = matching.rounded(np.array([q[j] for j in part]).reshape(len(part), n) @ m.T)
                            found.add(np.repeat(part, len(some)), score.ravel(), np.tile(ids[some], len(part)))
                            scored_rows[np.ix_(part, some)] = True
                cell, row = np.nonzero(~scored_rows)
                if len(cell):
                    found.add(cell, np.zeros(len(cell)), ids[row], np.ones(len(cell), bool))
            cell, _, ids, score, missing = found.settle()
            yield from matching.batches([asked.take(pa.array(cell)), pa.array(ids), pa.array(score, mask=missing)], out)

        return rows.mapInArrow(scan, schema)

    return matching.union([against(b) for b in matching.blocks(queries, "query_id", QUERIES)])


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def diversified(candidates: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: candidates (query_id, vec_id, score, v) of each query, of which there are at
    most fetch_k, are chosen greedily by trade * score - (1 - trade) * (most similar chosen one)."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "vec_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        v, relevance = np.stack(rows["v"].to_numpy()), rows["score"].to_numpy(float)
        near, open_, out = np.full(len(rows), -np.inf), np.ones(len(rows), bool), []
        for _ in range(min(k, len(rows))):
            value = np.where(open_, relevance if not out else trade * relevance - (1 - trade) * near, -np.inf)
            best = int(np.argmax(np.round(value, 9)))
            open_[best] = False
            out.append(best)
            near = np.maximum(near, v @ v[best])
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "rank": range(1, len(out) + 1), "vec_id": rows["vec_id"].iloc[out].to_numpy(), "score": relevance[out]})

    return candidates.select("query_id", "vec_id", "score", "v").groupBy("query_id").applyInPandas(choose, "query_id long, rank int, vec_id long, score double")
