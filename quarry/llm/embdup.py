"""Near-duplicate embeddings by random-hyperplane hashing, exact cosine and connected components.

Equal vectors of a label form one class with one representative. Each representative is hashed by the signs of
its projections in several tables; the number of bits follows the logarithm of the largest label's size, and
the number of tables follows from the bits and the wanted recall at the threshold. Vectors and planes are rounded
to whole numbers for the signs, so that projections are exact and a code is the same wherever it is computed.

Codes are written once, and buckets are counted from them alone. Within a bucket all cosines are computed as a
matrix, in tiles of bounded size where a bucket is large. A pair counts in the first table that brings it
together: a tile computes the earlier tables' codes of its vectors again instead of carrying them along. So each
vector's links are summed without any list of pairs, and a tile sends on one edge per vertex of its components.

Defined results: a vector that is null, empty, zero, or holds null or non-finite parts, or whose label is null,
links with nothing and is kept; vectors of unlike lengths don't link; a null vec_id links with nothing and is
kept; ids are whole numbers, and a vec_id that is none raises an error; rows with equal vec_id are one vertex; an
empty table gives an empty result; only vec_id, embedding and label are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, joined
from quarry.llm.components import connected

COSINE, MISS, BUCKET, TILE, SEED = 0.93, 1e-3, 512, 1024, 5
#: Whole numbers that a unit vector's part and a plane's are rounded to: sums of their products stay below 2^53.
FINE, COARSE = 1 << 20, 1 << 9
PLACE = ["label", "size", "tab", "code"]


def tables_for(largest: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits and tables: buckets of about BUCKET vectors, and at most `miss` of the pairs at the threshold lost."""
    bits = min(24, max(1, round(math.log2(max(1, largest) / BUCKET))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def usable() -> F.Column:
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no square of a part can overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@functools.lru_cache(maxsize=4)
def planes(size: int, n: int) -> np.ndarray:
    """n planes of that many parts, the first ones alike for every n."""
    return np.stack([np.rint(np.random.default_rng([SEED, size, i]).normal(size=size) * COARSE) for i in range(n)], axis=1)


def codes_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """x: unit vectors. A number of `bits` signs for each vector and table."""
    signs = (np.rint(x * FINE) @ planes(x.shape[1], bits * tables) > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.int32)


def hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """label, size, rep, n, embedding and codes, one for each table."""

    def run(batches):
        for batch in batches:
            for size in sorted(set(batch.column(1).to_pylist())):
                part = batch.filter(pc.equal(batch.column(1), size))
                codes = codes_of(unit(matrix(part.column(4))), bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * tables, pa.int32()), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "codes"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    return classes.select("label", F.size("embedding").alias("size"), "rep", "n", "embedding").mapInArrow(run, f"label {kinds['label']}, size int, rep long, n long, embedding {kinds['embedding']}, codes array<int>")


def linked(found: np.ndarray) -> np.ndarray:
    """The least index of each row's component, for a symmetric matrix with a true diagonal."""
    low = np.arange(len(found), dtype=np.int32)
    while len(found):
        new = np.where(found, low[None, :], np.int32(len(found))).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    return low


def tiles(rows: DataFrame, cosine: float, bits: int) -> DataFrame:
    """vertex, links, root: each class's links first met in a tile, and its component's least vertex there."""

    def run(table: pa.Table) -> pa.Table:
        tab, first, second = (table[c][0].as_py() for c in ("tab", "first", "second"))
        rep, n, block = (table[c].to_numpy() for c in ("rep", "n", "block"))
        x = unit(matrix(table["embedding"]))
        found = x @ x.T >= cosine
        np.fill_diagonal(found, False)
        if first != second:  # each block's own pairs are in its own tile
            found &= block[:, None] != block[None, :]
        use = np.flatnonzero(found.any(axis=1))  # most vectors have no neighbour
        rep, n, found = rep[use], n[use], found[np.ix_(use, use)]
        if tab:
            codes = codes_of(x[use], bits, tab)
            new = found.copy()
            for t in range(tab):
                new &= codes[:, t][:, None] != codes[:, t][None, :]
        else:
            new = found
        links = (new * n[None, :]).sum(axis=1).astype(np.int64)
        np.fill_diagonal(found, True)
        order = np.argsort(rep, kind="stable")
        root = np.empty(len(rep), np.int64)
        root[order] = rep[order][linked(found[np.ix_(order, order)])]
        some = (links > 0) | (root != rep)
        return pa.table({"vertex": pa.array(rep[some]), "links": pa.array(links[some]), "root": pa.array(root[some])})

    return rows.groupBy(*PLACE, "first", "second").applyInArrow(run, "vertex long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """For each row: vec_id, n_links, component_id, kept."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    ok = base.filter(usable())
    keyed = ok.withColumn("h1", F.xxhash64(F.lit(1), "label", "embedding")).withColumn("h2", F.xxhash64(F.lit(2), "embedding", "label"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    classes = cut(classes, "vec-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, n_tables = tables_for(largest, cosine, miss)
    rows = cut(hashed(classes, bits, n_tables), "vec-hashed")
    each = F.posexplode("codes").alias("tab", "code")
    # buckets of one vector go nowhere; those over TILE vectors are cut into blocks, and each pair of blocks is a tile of its own
    counts = cut(rows.select("label", "size", each).groupBy(*PLACE).count().filter("count > 1").select(*PLACE, F.ceil(F.col("count") / TILE).cast("int").alias("blocks")), "vec-buckets")
    cells = joined(rows.select("label", "size", "rep", "n", "embedding", each), counts, PLACE)
    cells = cells.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    met = cut(tiles(cells.select(*PLACE, "first", "second", "block", "rep", "n", "embedding"), cosine, bits), "vec-met")
    links = met.groupBy("vertex").agg(F.sum("links").alias("links"))
    roots = connected(met.select(F.col("vertex").alias("a"), F.col("root").alias("b")))
    by_class = classes.select("h1", "h2", "rep", "n").join(links, F.col("rep") == F.col("vertex"), "left").join(roots, F.col("rep") == F.col("id"), "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    found = joined(keyed.select("vec_id", "h1", "h2"), cut(by_class, "vec-found"), ["h1", "h2"])
    out = found.select("vec_id", "links", "root").unionByName(base.filter(~usable()).select("vec_id", F.lit(0).alias("links"), F.lit(None).cast("long").alias("root")))
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
