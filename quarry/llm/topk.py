"""Exact top-k inner products by best-first search in M-trees.

With one more part sqrt(M - |x|^2), M the largest squared norm, every vector has length sqrt(M), and for a query
|q|^2 + M - 2<q, x> is a squared Euclidean distance: the largest products are the nearest neighbours. Vectors go
to the nearest of a bounded number of pivots, the routing objects of the tree's root; a large cell is cut into
shells by distance to its pivot, and shells that stay too large (equal vectors) by hash. The directory holds the
pivots and each shell's least and greatest distance; its size is bounded by parameters. Each chunk is an M-tree
of its own: pages of at most PAGE entries, each with a routing entry, a covering radius, and its entries'
distances to the routing entry, in their order.

A query first searches its home chunk. Its k-th score there rules out, by the triangle inequality, shells of the
directory before anything moves; it is sent to the chunks that are left, and only those. Within a chunk, pages
are visited best bound first, as long as a page's bound can beat a query's k-th score, and only the stretch of
entries whose stored distances the inequality allows is computed. A chunk is copied once per QUERIES queries sent
to it.

Components are floor(64 * x), so scores are integers, exact in doubles as long as squared norms stay below SMALL.
Vectors beyond that, and those of lengths other than the LENGTHS most frequent ones, are kept in chunks without a
tree, which all queries of their length visit: scores are computed in doubles with a bound on their error, and
what the bound leaves open is computed again in whole numbers of any size.

Defined results: vectors that are null or hold null or non-finite parts take no part; those of unlike lengths
aren't compared; rows with the query's vec_id are never its results, and equal rows of a query are one query;
ties go to the smaller vec_id; repeated rows each count; with fewer than k candidates all are returned; scores
beyond 64 bits are ranked exactly and returned as the nearest long; only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut, joined

K, STEP = 20, 20
#: Entries and bytes of a chunk, entries of a page, queries that share a copy of a chunk.
CHUNK, CHUNK_BYTES, PAGE, QUERIES = 16_384, 32 << 20, 128, 8192
#: The directory: pivots of each length, shells of a cell, lengths; fitted on SAMPLE vectors at most.
PIVOTS, SHELLS, LENGTHS, SAMPLE = 1024, 64, 16, 20_000
#: Squared norms from which scores aren't sure to be exact in doubles, with room for a place in one integer.
SMALL = float(1 << 45)
#: Parts from which doubles of a product may overflow.
HUGE = 2.0**500
#: Room for rounding in distances; scores themselves are exact.
SLACK = 1e-6
NONE = -(1 << 62)
FOUND = "query_id long, twin long, vec_id long, score long, beyond string"
CHUNK_KEY = ["d", "entry", "part"]


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, z, d, norm: the usable vectors in whole 64ths (z, exact in doubles) and their squared norms in units."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.coalesce(~odd, F.lit(False))
    # from 2^46 on a double is a whole number of 64ths
    whole = lambda x: F.when(F.abs(x) < float(1 << 46), F.floor(x.cast("double") * 64).cast("double") / 64).otherwise(x.cast("double"))
    rows = vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("z"))
    return rows.withColumn("d", F.size("z")).withColumn("norm", F.aggregate("z", F.lit(0.0), lambda a, x: a + x * 64 * (x * 64)))


def chunk_rows(d: int) -> int:
    return max(64, min(CHUNK, CHUNK_BYTES // (8 * max(1, d))))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), len(column[0]) if len(column) else 0)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def as_query(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def best_possible(norm: np.ndarray, most: float, least_distance: np.ndarray) -> np.ndarray:
    """The largest score at a distance of that much at least."""
    return (norm + most - np.maximum(0, least_distance - SLACK) ** 2) / 2 + SLACK


class Shells(NamedTuple):
    """The directory of one length: shells by entry number, with their cell, distances and number of chunks."""

    most: float
    pivots: np.ndarray
    cell: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    parts: np.ndarray


def fit_pivots(rows: DataFrame, sizes: dict[int, tuple[int, float]]) -> dict[int, np.ndarray]:
    """Pivots by length of vector: means of a bounded sample, chosen by hash, after three rounds."""
    if not sizes:
        return {}
    n = sum(size for size, _ in sizes.values())
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(max(1, n))) < SAMPLE)
    part = chosen.orderBy(F.xxhash64(F.lit(9), "vec_id", "z"), "vec_id").limit(2 * SAMPLE).select("z").toPandas()
    out = {}
    for d, (size, most) in sizes.items():
        x = [v for v in part["z"] if len(v) == d]
        x = augmented(np.array(x, dtype=np.float64).reshape(len(x), d) * 64 if x else np.zeros((1, d)), most)
        pivots = x[np.random.default_rng(1).permutation(len(x))[: min(PIVOTS, max(1, math.ceil(size / chunk_rows(d))))]]
        for _ in range(3):
            near = distances(x, pivots).argmin(axis=1)
            pivots = np.stack([x[near == i].mean(axis=0) if (near == i).any() else p for i, p in enumerate(pivots)])
        out[d] = pivots
    return out


def by_length(batch: pa.RecordBatch, place: int):
    lengths = batch.column(place)
    for d in sorted(set(lengths.to_pylist())):
        yield d, batch.filter(pc.equal(lengths, d))


def in_cells(rows: DataFrame, pivots: dict[int, np.ndarray], most: dict[int, float]) -> DataFrame:
    """vec_id, z, d, cell, reach: the nearest pivot and the distance to it; cell -1 where there is no tree."""

    def run(batches):
        for batch in batches:
            for d, part in by_length(batch, 2):
                has = part.column(3).to_numpy(zero_copy_only=False)
                cell, reach = np.full(part.num_rows, -1, np.int32), np.zeros(part.num_rows)
                if has.any():
                    away = distances(augmented(matrix(part.column(1).filter(part.column(3))) * 64, most[d]), pivots[d])
                    cell[has], reach[has] = away.argmin(axis=1), away.min(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(cell), pa.array(reach)], ["vec_id", "z", "d", "cell", "reach"])

    in_tree = F.col("d").isin(list(pivots)) & (F.col("norm") < SMALL) if pivots else F.lit(False)
    return rows.select("vec_id", "z", "d", in_tree.alias("tree")).mapInArrow(run, "vec_id long, z array<double>, d int, cell int, reach double")


def in_chunks(placed: DataFrame, pivots: dict[int, np.ndarray], most: dict[int, float]) -> tuple[DataFrame, dict[int, Shells]]:
    """placed with its chunk's key (d, entry, part; entry -1 without a tree), and the directory."""
    spark = placed.sparkSession
    marks = [i / SHELLS for i in range(1, SHELLS)]
    tree = placed.filter("cell >= 0")
    cells = []
    # a row per cell: at most PIVOTS of each of LENGTHS lengths
    for r in tree.groupBy("d", "cell").agg(F.count("*").alias("n"), F.percentile_approx("reach", marks, 2000).alias("marks")).collect():
        shells = min(SHELLS, math.ceil(r["n"] / chunk_rows(r["d"])))
        cells.append((r["d"], r["cell"], [float(r["marks"][i * SHELLS // shells - 1]) for i in range(1, shells)]))
    cells = spark.createDataFrame(sorted(cells), "d int, cell int, cuts array<double>")
    shelled = tree.join(F.broadcast(cells), ["d", "cell"]).withColumn("shell", F.size(F.filter("cuts", lambda c: c < F.col("reach"))))
    # at most SHELLS rows for each cell
    found = sorted(tuple(r) for r in shelled.groupBy("d", "cell", "shell").agg(F.count("*"), F.min("reach"), F.max("reach")).collect())
    rows, directory = [], {}
    for d in sorted({r[0] for r in found}):
        own = [r for r in found if r[0] == d]
        parts = [math.ceil(r[3] / chunk_rows(d)) for r in own]
        rows += [(d, r[1], r[2], e, p) for e, (r, p) in enumerate(zip(own, parts, strict=True))]
        directory[d] = Shells(most[d], pivots[d], *(np.array([r[i] for r in own]) for i in (1, 4, 5)), np.array(parts))
    entries = spark.createDataFrame(rows, "d int, cell int, shell int, entry int, parts int")
    spread = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    with_tree = shelled.join(F.broadcast(entries), ["d", "cell", "shell"]).select("vec_id", "z", "d", "entry", spread)
    rest = placed.filter("cell < 0")
    counts = cut(rest.groupBy("d").agg(F.ceil(F.count("*") / F.greatest(F.lit(64), F.least(F.lit(CHUNK), F.expr(f"{CHUNK_BYTES} div (8 * greatest(d, 1))")))).cast("int").alias("parts")), "knn-lengths")
    without = joined(rest, counts, "d").select("vec_id", "z", "d", F.lit(-1).alias("entry"), spread)
    return with_tree.unionByName(without), directory


def paged(chunks: DataFrame, most: dict[int, float]) -> DataFrame:
    """The M-tree of each chunk: its entries with page, routing flag and distance to the page's routing entry."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        n = table.num_rows
        page, routing, reach = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n)
        if table["entry"][0].as_py() >= 0:
            x = augmented(matrix(table["z"]) * 64, most[table["d"][0].as_py()])
            todo, done = [np.arange(n)], 0
            while todo:
                rows = todo.pop()
                if len(rows) > PAGE:
                    far = rows[distances(x[rows], x[rows].mean(axis=0)[None]).argmax()]
                    away = rows[distances(x[rows], x[far][None]).argmax()]
                    order = np.argsort(x[rows] @ (x[away] - x[far]), kind="stable")
                    todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
                    continue
                middle = rows[distances(x[rows], x[rows].mean(axis=0)[None]).argmin()]
                page[rows], routing[middle], reach[rows] = done, True, distances(x[rows], x[middle][None])[:, 0]
                done += 1
        return table.select([*CHUNK_KEY, "vec_id", "z"]).append_column("page", pa.array(page)).append_column("routing", pa.array(routing)).append_column("reach", pa.array(reach))

    return chunks.groupBy(*CHUNK_KEY).applyInArrow(run, "d int, entry int, part int, vec_id long, z array<double>, page int, routing boolean, reach double")


class Tree:
    """A chunk's pages, entries in the order of their distances to the routing entry."""

    def __init__(self, table: pa.Table, most: float):
        order = np.lexsort((table["vec_id"].to_numpy(), table["reach"].to_numpy(), table["page"].to_numpy()))
        column = lambda c: table[c].to_numpy()[order]
        self.ids, self.reach, self.x, self.most = column("vec_id"), column("reach"), (matrix(table["z"]) * 64)[order], most
        page = column("page")
        self.cuts = np.searchsorted(page, np.arange(page[-1] + 2))
        self.routing = augmented(self.x[np.flatnonzero(column("routing"))], most)
        self.radius = self.reach[self.cuts[1:] - 1]
        # one integer holds score and, for ties, the place by id
        self.width = len(self.ids) + 1
        self.place = np.empty(len(self.ids), np.int64)
        self.place[np.argsort(self.ids, kind="stable")] = np.arange(len(self.ids) - 1, -1, -1)
        self.by_place = np.sort(self.ids, kind="stable")[::-1]

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, ids and scores of each query's k best entries that score `floor` at least."""
        norm = (q * q).sum(axis=1)
        to_page = distances(as_query(q), self.routing)
        bound = best_possible(norm[:, None], self.most, to_page - self.radius[None, :])
        top, kth = np.full((len(q), k), NONE, np.int64), floor.astype(np.float64)

        def visit(p: int, rows: np.ndarray) -> None:
            rows = rows[bound[rows, p] >= kth[rows]]
            if not len(rows):
                return
            away = np.sqrt(np.maximum(0, norm[rows] + self.most - 2 * (kth[rows] - SLACK))) + SLACK
            a, b = self.cuts[p], self.cuts[p + 1]
            first, last = (to_page[rows, p] - away).min(), (to_page[rows, p] + away).max()
            a, b = a + np.searchsorted(self.reach[a:b], first), a + np.searchsorted(self.reach[a:b], last, "right")
            scores = q[rows] @ self.x[a:b].T
            good = scores >= kth[rows][:, None]
            some = good.any(axis=1)
            if not some.any():
                return
            rows, scores, good = rows[some], scores[some], good[some]
            good &= self.ids[a:b][None, :] != q_ids[rows][:, None]
            both = np.concatenate([top[rows], np.where(good, scores.astype(np.int64) * self.width + self.place[a:b][None, :], NONE)], axis=1)
            top[rows] = -np.partition(-both, k - 1, axis=1)[:, :k]
            worst = top[rows].min(axis=1)
            kth[rows] = np.maximum(kth[rows], np.where(worst > NONE, worst // self.width, -np.inf))

        best = bound.argmax(axis=1)
        for p in np.unique(best):  # each query's best page, for a first k-th score
            visit(p, np.flatnonzero(best == p))
        for p in np.argsort(-bound.max(axis=0), kind="stable"):
            visit(p, np.flatnonzero(best != p))
        at, column = np.nonzero(top > NONE)
        value = top[at, column]
        return at, self.by_place[value % self.width], value // self.width


def whole(z: np.ndarray) -> list[int]:
    return [int(v * 64) if abs(v) < 1 << 46 else int(v) * 64 for v in z.tolist()]


def exact_search(ids: np.ndarray, z: np.ndarray, q_ids: np.ndarray, qz: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """The same without a tree, for parts of any size: doubles with a bound on their error, then whole numbers."""

    def plain(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        huge = (np.abs(z) >= HUGE).any(axis=1)
        y = np.where(huge[:, None], 0.0, z) * 64
        return y, np.where(huge, np.inf, np.sqrt((y * y).sum(axis=1)))

    (x, x_norm), (q, q_norm) = plain(z), plain(qz)
    seen: dict[int, list[int]] = {}
    rows, found, scores = [], [], []
    for i in range(len(q)):
        approx = x @ q[i]
        with np.errstate(invalid="ignore"):
            most = np.where((q_norm[i] == 0) | (x_norm == 0), 0.0, q_norm[i] * x_norm)
        error = np.where(most < 1 << 52, 0.0, (len(q[i]) + 4) * 2.0**-52 * most)
        others = np.flatnonzero(ids != q_ids[i])
        low, high = (approx - error)[others], (approx + error)[others]
        least = max(floor[i], np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf)
        mine = whole(qz[i])
        for j in others[high >= least].tolist():
            if j not in seen:
                seen[j] = whole(z[j])
            rows.append(i)
            found.append(int(ids[j]))
            scores.append(sum(a * b for a, b in zip(mine, seen[j], strict=True)))
    return rows, found, scores


def beyond(score: int) -> tuple[int, str]:
    """A score as the nearest long, and what orders scores beyond 64 bits among themselves, in descending order."""
    if -(1 << 63) < score < 1 << 63:
        return score, ""
    text = format(abs(score), "d")
    text = f"{len(text):06d}{text}"
    return ((1 << 63) - 1, text) if score > 0 else (-(1 << 63), text.translate(str.maketrans("0123456789", "9876543210")))


def search(sent: DataFrame, chunks: DataFrame, k: int, directory_most: dict[int, float]) -> DataFrame:
    """sent: d, entry, part, query_id, twin, q, tree, floor, one row per query and chunk. Their k best there."""
    sent = sent.withColumn("floor", F.col("floor").cast("double"))
    counts = cut(sent.groupBy(*CHUNK_KEY).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies")), "knn-copies")
    queries = joined(sent, counts, CHUNK_KEY).withColumn("copy", F.pmod(F.xxhash64("query_id"), "copies").cast("int"))
    copied = joined(chunks, counts, CHUNK_KEY).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            d, has_tree = left["d"][0].as_py(), left["entry"][0].as_py() >= 0
            for in_tree in (True, False):
                own = right.filter(pc.equal(right["tree"], in_tree))
                if not own.num_rows:
                    continue
                q_ids, q, floor = own["query_id"].to_numpy(), matrix(own["q"]), own["floor"].to_numpy()
                if in_tree and has_tree:
                    at, ids, scores = Tree(left, directory_most[d]).search(q_ids, q * 64, floor, k)
                    late = [""] * len(at)
                else:
                    at, ids, scores = exact_search(left["vec_id"].to_numpy(), matrix(left["z"]), q_ids, q, floor, k)
                    scores, late = zip(*map(beyond, scores), strict=True) if scores else ((), ())
                at = pa.array(at, pa.int64())
                for c, v in zip(columns, (own["query_id"].take(at), own["twin"].take(at), pa.array(ids, pa.int64()), pa.array(scores, pa.int64()), pa.array(late, pa.string())), strict=True):
                    c.append(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v)
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.concat_arrays(c) if c else pa.array([], kind) for c, kind in zip(columns, kinds, strict=True)], ["query_id", "twin", "vec_id", "score", "beyond"])

    key = [*CHUNK_KEY, "copy"]
    return copied.groupBy(*key).cogroup(queries.drop("copies").groupBy(*key)).applyInArrow(run, FOUND)


def routed(queries: DataFrame, directory: dict[int, Shells]) -> DataFrame:
    """query_id, twin, floor, d, entry, part: the chunks, without the home, that the directory can't rule out."""

    def run(batches):
        names = ["query_id", "twin", "floor", *CHUNK_KEY]
        for batch in batches:
            for d, own in by_length(batch, 3):
                shells = directory[d]
                entry, part = np.repeat(np.arange(len(shells.parts)), shells.parts), np.concatenate([np.arange(p) for p in shells.parts])
                q, floor = matrix(own.column(6)) * 64, own.column(2).to_numpy(zero_copy_only=False)
                away = distances(as_query(q), shells.pivots)[:, shells.cell]
                bound = best_possible((q * q).sum(axis=1)[:, None], shells.most, np.maximum(away - shells.greatest, shells.least - away))
                home = (entry[None, :] == own.column(4).to_numpy()[:, None]) & (part[None, :] == own.column(5).to_numpy()[:, None])
                for at in range(0, len(q), 64):
                    rows, column = np.nonzero((bound[at : at + 64] >= floor[at : at + 64, None])[:, entry] & ~home[at : at + 64])
                    rows = pa.array(rows + at)
                    yield pa.RecordBatch.from_arrays([*[own.column(i).take(rows) for i in range(3)], pa.array(np.full(len(rows), d, np.int32)), pa.array(entry[column].astype(np.int32)), pa.array(part[column].astype(np.int32))], names)

    return queries.select("query_id", "twin", "floor", *CHUNK_KEY, "q").mapInArrow(run, "query_id long, twin long, floor double, d int, entry int, part int")


def top_k(vectors: DataFrame, k: int = K, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by step, its k best others."""
    base = cut(scaled(vectors), "knn-scaled")
    sizes = base.filter(F.col("norm") < SMALL).groupBy("d").agg(F.count("*").alias("n"), F.max("norm").alias("most"))
    sizes = {r["d"]: (r["n"], r["most"]) for r in sizes.orderBy(F.desc("n"), "d").limit(LENGTHS).collect() if r["d"]}
    most = {d: m for d, (_, m) in sizes.items()}
    pivots = fit_pivots(base.filter(F.col("d").isin(list(sizes)) & (F.col("norm") < SMALL)), sizes)
    placed = cut(in_cells(base, pivots, most), "knn-cells")
    chunked, directory = in_chunks(placed, pivots, most)
    tree = cut(paged(chunked, most), "knn-tree")
    own = tree.filter(F.pmod("vec_id", F.lit(step)) == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("z").alias("twin"), F.col("z").alias("q"), *CHUNK_KEY)
    queries = cut(own.dropDuplicates(["query_id", "twin"]).withColumn("tree", F.col("entry") >= 0), "knn-queries")
    low = F.lit(float("-inf"))
    columns = [*CHUNK_KEY, "query_id", "twin", "q", "tree", "floor"]
    home = cut(search(queries.filter("tree").withColumn("floor", low).select(columns), tree, k, most), "knn-home")
    floors = home.groupBy("query_id", "twin").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    known = queries.join(floors, ["query_id", "twin"], "left").withColumn("floor", F.coalesce("floor", low))
    ways = routed(known.filter("tree"), directory)
    # chunks without a tree see all queries of their length, and queries without one all chunks of their length
    chunks = cut(tree.groupBy(*CHUNK_KEY).count().drop("count"), "knn-chunks")
    open_queries = known.select("query_id", "twin", "floor", "d", "tree")
    rest = open_queries.join(chunks, "d").filter("not tree or entry < 0").select("query_id", "twin", "floor", *CHUNK_KEY)
    to = cut(ways.unionByName(rest), "knn-sent")
    sent = to.join(queries.select("query_id", "twin", "q", "tree"), ["query_id", "twin"]).select(columns)
    late = search(sent, tree, k, most)
    order = W.partitionBy("query_id", "twin").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return home.unionByName(late).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
