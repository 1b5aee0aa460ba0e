"""Chunking: fixed windows, greedy and overlapping sentence packing with tail repair, semantic cuts.

Tokens are code points unless a token count is given. Windows are expressions; packing depends on what came
before within a document, so it folds over one document's sentences at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def stride_windows(docs: DataFrame, size: int = 512, overlap: int = 102) -> DataFrame:
    """doc_id, chunk_order (from 1), char_start, char_end, chunk_text: windows of `size` tokens that overlap by
    `overlap`; the last one ends at the end of the text. An empty text has no chunk.

    All windows of a text are cut in one pass (each step looks ahead for its window), so that no window is looked
    for from the text's start, and no row carries more than its own window.
    """
    step = size - overlap
    n = F.length("text").cast("long")
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    windows = F.slice(F.regexp_extract_all("text", F.lit(rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)), F.lit(1), count)
    rows = docs.filter(n > 0).select("doc_id", F.posexplode(windows).alias("at", "chunk_text"))
    start = F.col("at").cast("long") * step
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("chunk_order"), start.alias("char_start"), (start + F.length("chunk_text")).alias("char_end"), "chunk_text")


def chunk_id(source: Column, size: int, overlap: int, order: Column) -> Column:
    return F.format_string(f"%s:N{size}O{overlap}:C%06d", source, order)


def overlapping_blocks(chunks: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of chunk and block whose half-open spans meet, an interval join within each document."""
    b = spans.select(F.col(key).alias("b_key"), F.col("char_start").alias("b_start"), F.col("char_end").alias("b_end"), "block_order")
    return chunks.join(b, (F.col(key) == F.col("b_key")) & (F.col("char_start") < F.col("b_end")) & (F.col("char_end") > F.col("b_start"))).drop("b_key")


def new_content(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds new_chars: what a chunk holds beyond all earlier ones of its document."""
    before = W.partitionBy(key).orderBy("chunk_order").rowsBetween(W.unboundedPreceding, -1)
    covered = F.coalesce(F.max("char_end").over(before), F.lit(0))
    return chunks.withColumn("new_chars", F.greatest(F.lit(0), F.col("char_end") - F.greatest("char_start", covered)).cast("long"))


def greedy_sizes(lengths: Column, limit: int, separator: int = 0) -> Column:
    """Sizes of greedily packed groups of items in order; an item over the limit is a group of its own."""
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).cast("bigint").alias("now"))

    def add(a: Column, x: Column) -> Column:
        fits = (a["now"] >= 0) & (a["now"] + separator + x <= limit)
        closed = F.when(a["now"] >= 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.struct(F.when(fits, a["done"]).otherwise(closed).alias("done"), F.when(fits, a["now"] + separator + x).otherwise(x).alias("now"))

    return F.aggregate(lengths, start, add, lambda a: F.when(a["now"] >= 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


@dataclass(frozen=True)
class Chunk:
    """Sentences first..last (inclusive), `offset` code points into the first, and how it came about."""

    first: int
    last: int
    size: int
    overlap: int = 0
    offset: int = 0
    mode: str = "packed"


def pack(lengths: list[int], limit: int, overlap: int = 0, minimum_tail: int = 0, cuts: frozenset[int] = frozenset(), minimum: int = 0) -> list[Chunk]:
    """Pack sentences of the given lengths into chunks of at most `limit` tokens.

    Semantic `cuts` (indices after which to cut) close a chunk that has `minimum` tokens, if what remains has so
    many too or exceeds the limit. Consecutive chunks share whole sentences of at most `overlap` tokens, else the
    last `overlap` tokens of the chunk before. A sentence over the limit is cut into windows with exact overlap.
    """
    chunks: list[Chunk] = []
    i, carry, carried, n = 0, 0, 0, len(lengths)
    start = 0
    before = [0, *accumulate(lengths)]
    while i < n:
        if lengths[i] > limit:
            at = 0
            while True:
                size = min(limit, lengths[i] - at)
                chunks.append(Chunk(i, i, size, overlap if at else 0, at, "oversized"))
                if at + size >= lengths[i]:
                    break
                at += size - overlap
            i += 1
            start, carry, carried = i, 0, 0
            continue
        size, j = carry + before[i] - before[start], i
        while j < n and lengths[j] <= limit and size + lengths[j] <= limit:
            size += lengths[j]
            j += 1
            rest = before[n] - before[j]
            if j < n and j - 1 in cuts and size >= minimum and (rest >= minimum or rest > limit):
                break
        if j == i:  # nothing fits beside what was carried
            start, carry, carried = i, 0, 0
            continue
        chunks.append(Chunk(start, j - 1, size, carried, carry))
        first, i = start, j
        start, carry, carried = i, 0, 0
        if overlap and i < n and lengths[i] <= limit:
            k, kept = i, 0
            while k - 1 > first and kept + lengths[k - 1] <= overlap and kept + lengths[k - 1] + lengths[i] <= limit:
                k -= 1
                kept += lengths[k]
            if kept:
                start, carried = k, kept
            elif size > overlap:
                carry = carried = overlap
    return repaired(chunks, lengths, limit, minimum_tail or overlap)


def repaired(chunks: list[Chunk], lengths: list[int], limit: int, least: int) -> list[Chunk]:
    """Give a last chunk with little new content more: merge it, move sentences to it, or lean on its overlap."""
    if len(chunks) < 2 or chunks[-1].mode == "oversized" or chunks[-2].mode == "oversized":
        return chunks
    left, right = chunks[-2], chunks[-1]
    new = right.size - right.overlap
    if new >= least:
        return chunks
    if left.size + new <= limit:
        return [*chunks[:-2], replace(left, last=right.last, size=left.size + new, mode="merged_with_previous")]
    # whole sentences that begin in the chunk before, ahead of what the last chunk already shares with it
    shared = right.offset if right.offset else 0
    before = [0, *accumulate(lengths)]
    for k in range(left.last, left.first, -1):
        if before[max(k, right.first)] - before[k] <= shared:
            continue
        size, given = before[right.last + 1] - before[k], before[left.last + 1] - before[k]
        if least <= size <= limit and left.size - given - left.overlap > 0:
            return [*chunks[:-2], replace(left, last=k - 1, size=left.size - given), Chunk(k, right.last, size, mode="whole_sentence_rebalance")]
    if right.overlap and right.size >= least:
        return [*chunks[:-1], replace(right, mode="existing_overlap_context")]
    lean = min(least - new, left.size, limit - new)
    return [*chunks[:-1], replace(right, size=new + lean, overlap=lean, offset=lean, mode="safe_token_overlap_fallback")]


def pack_sentences(sentences: DataFrame, limit: int = 512, overlap: int = 51, minimum_tail: int = 0, minimum: int = 0) -> DataFrame:
    """sentences: doc_id, sentence_index, n_tokens, cut_after (boolean). One document is folded at a time."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sentence_index", kind="stable")
        cuts = frozenset(i for i, c in enumerate(rows["cut_after"]) if c)
        out = pack([int(n) for n in rows["n_tokens"]], limit, overlap, minimum_tail, cuts, minimum)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "chunk_order": range(1, len(out) + 1), "first_sentence": [c.first for c in out], "last_sentence": [c.last for c in out], "size": [c.size for c in out], "overlap": [c.overlap for c in out], "mode": [c.mode for c in out]})

    return sentences.select("doc_id", "sentence_index", "n_tokens", "cut_after").groupBy("doc_id").applyInPandas(fold, "doc_id long, chunk_order long, first_sentence long, last_sentence long, size long, overlap long, mode string")


def pack_texts(docs: DataFrame, splitter: Callable[[Column], Column], limit: int = 512, overlap: int = 51, minimum_tail: int = 0, tokens: Callable[[Column], Column] = F.length) -> DataFrame:
    """What pack_sentences gives for the sentences of each document, without cuts: as these are in one row already,
    only their lengths leave it, and nothing is shuffled or sorted."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("chunk_order", "first_sentence", "last_sentence", "size", "overlap")], T.StructField("mode", T.StringType())])
    out = to_arrow_schema(schema)

    def fold(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            row: list[int] = []
            order: list[int] = []
            chunks: list[Chunk] = []
            for i, lengths in enumerate(batch["lengths"].to_pylist()):
                packed = pack(lengths or [], limit, overlap, minimum_tail)
                row += [i] * len(packed)
                order += range(1, len(packed) + 1)
                chunks += packed
            numbers = [order, *[[getattr(c, n) for c in chunks] for n in ("first", "last", "size", "overlap")]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row, pa.int64())), *[pa.array(n, pa.int64()) for n in numbers], pa.array([c.mode for c in chunks], pa.string())], schema=out)

    lengths = F.transform(splitter(F.col("text")), lambda s: tokens(s).cast("long"))
    return docs.select("doc_id", lengths.alias("lengths")).mapInArrow(fold, schema)


def sentence_rows(docs: DataFrame, splitter: Callable[[Column], Column], tokens: Callable[[Column], Column] = F.length) -> DataFrame:
    """doc_id, sentence_index (from 0), sentence, n_tokens, cut_after = false."""
    rows = docs.select("doc_id", F.posexplode(splitter(F.col("text"))).alias("sentence_index", "sentence"))
    return rows.select("doc_id", F.col("sentence_index").cast("long").alias("sentence_index"), "sentence", tokens(F.col("sentence")).cast("long").alias("n_tokens"), F.lit(False).alias("cut_after"))
