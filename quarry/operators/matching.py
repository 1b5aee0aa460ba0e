"""One pass of a large table against stated queries, without a shuffle of their pairs.

Queries are sets of terms, kept as postings (term: queries) in blocks of bounded size that go to all tasks; rows come
as arrays of terms, or as vectors. What a task holds is bounded by a block, a batch and the best rows of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: (query, term) rows of a block, cells of a numeric step, rows of an outgoing batch.
BLOCK_ROWS, CELLS, OUT_ROWS = 1 << 18, 1 << 21, 1 << 16


def blocks(rows: DataFrame, key: str, most: int | None = None) -> list[DataFrame]:
    """rows in parts of about `most` rows each, all of a key in one; they are counted first."""
    n = -(-rows.count() // (most or BLOCK_ROWS))
    return [rows] if n <= 1 else [rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as a numpy array that sorts as Spark does: numbers, or texts by code point."""
    out = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return out.astype(str) if out.dtype == object else out


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


@dataclass
class Asked:
    """Queries as postings. terms: distinct; those of term t are entries start[t] to start[t + 1]."""

    ids: pa.Array
    terms: pa.Array
    start: np.ndarray
    query: np.ndarray
    times: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, key: str = "query_id", times: str | None = None) -> Asked:
        """rows: key, term, one for each pair, collected: a block's."""
        table = rows.select(key, "term", *([times] if times else [])).toArrow()
        ids, terms = table[key].combine_chunks().dictionary_encode(null_encoding="encode"), table["term"].combine_chunks().dictionary_encode()
        query, term = (x.indices.to_numpy().astype(np.int64) for x in (ids, terms))
        order = np.argsort(term, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms.dictionary)))]).astype(np.int64)
        counts = table[times].to_numpy().astype(float)[order] if times else np.ones(len(order))
        return cls(ids.dictionary, terms.dictionary, start, query[order], counts, np.bincount(query, minlength=len(ids.dictionary)))

    def found(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, term, times of the asked terms in rows of term lists, by row."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        there = at >= 0
        row = np.repeat(np.arange(len(lists)), sizes)[there]
        key, times = np.unique(row * len(self.terms) + at[there], return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), times

    def pairs(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """row, query, number of shared terms and, with weights, the sum of weight * times over them, for each pair
        that shares a term; row and term are ordered by row. A step takes as many rows as CELLS leaves, one at least."""
        n_queries, spread = len(self.ids), self.start[term + 1] - self.start[term]
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        done = np.concatenate([[0], np.cumsum(spread)])
        ends = np.append(heads[1:], len(row))
        i = 0
        while i < len(heads):
            j = max(i + 1, min(int(np.searchsorted(done[ends], done[heads[i]] + CELLS, "right")), i + max(1, CELLS // max(1, n_queries))))
            a, b = heads[i], ends[j - 1]
            n = spread[a:b]
            entry = np.arange(done[b] - done[a]) - np.repeat(done[a:b] - done[a], n) + np.repeat(self.start[term[a:b]], n)
            local = np.repeat(np.arange(j - i), ends[i:j] - heads[i:j])
            cell = np.repeat(local * n_queries, n) + self.query[entry]
            shared = np.bincount(cell, minlength=(j - i) * n_queries)
            some = np.flatnonzero(shared)
            total = None if weight is None else np.bincount(cell, np.repeat(weight[a:b], n) * self.times[entry], len(shared))[some]
            yield row[heads[i:j]][some // n_queries], some % n_queries, shared[some], total
            i = j


class Best:
    """The k best of each cell, by score from the top and then by id. NaN is above all, as in Spark."""

    def __init__(self, cells: int, k: int):
        self.k, self.least = k, np.full(cells, -np.inf)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, cell: np.ndarray, score: np.ndarray, ident: np.ndarray, missing: np.ndarray | None = None) -> None:
        """missing: scores that are null, and come last."""
        key = np.where(np.isnan(score), np.inf, score)
        if missing is not None:
            key = np.where(missing, -np.inf, key)
        some = np.flatnonzero(key >= self.least[cell])
        self.kept.append((cell[some], key[some], ident[some], score[some], np.zeros(len(some), bool) if missing is None else missing[some]))
        self.waiting += len(some)
        if self.waiting > CELLS:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """cell, key, id, score, missing of what is best so far."""
        if not self.kept:
            return (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        cell, key, ident, score, missing = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((ident, -key, cell))
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        order, place = order[place < self.k], place[place < self.k]
        out = tuple(x[order] for x in (cell, key, ident, score, missing))
        full = place == self.k - 1
        self.least[out[0][full]] = out[1][full]
        self.kept, self.waiting = [out], 0
        return out


def batches(columns: list[pa.Array], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(at, OUT_ROWS).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlaps(rows: DataFrame, asked: DataFrame, ident: str, key: str, least: tuple[int, int] | None = None, similar: float | None = None) -> DataFrame:
    """rows: ident, terms (distinct ones); asked: key, term. key, ident, n (terms shared) of pairs that share at least
    least[0] / least[1] of the query's terms, or whose Jaccard similarity is at least `similar` (then with it, to 6 decimals)."""
    schema = T.StructType([asked.schema[key], rows.schema[ident], T.StructField("n", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def against(block: DataFrame) -> DataFrame:
        sets, out = Asked.of(block, key), to_arrow_schema(schema)

        def scan(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in incoming:
                row, term, _ = sets.found(batch["terms"])
                sizes = pc.fill_null(pc.list_value_length(batch["terms"]), 0).to_numpy(zero_copy_only=False)
                for at, query, n, _ in sets.pairs(row, term):
                    value = n / (sizes[at] + sets.sizes[query] - n)
                    good = np.flatnonzero(value >= similar if similar is not None else n * least[1] >= least[0] * sets.sizes[query])
                    yield from batches([sets.ids.take(pa.array(query[good])), batch[ident].take(pa.array(at[good])), pa.array(n[good]), pa.array(rounded(value[good]))], out)

        return rows.select(ident, "terms").mapInArrow(scan, schema)

    return union([against(b) for b in blocks(asked, key)])
