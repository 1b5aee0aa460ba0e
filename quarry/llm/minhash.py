"""Near-duplicate detection by b-bit MinHash, verified on full shingle sets.

Texts are lower-cased in A-Z and cut into words `[^\\x20\\x09-\\x0D]+`; a document's set holds its distinct
runs of five words. Equal sets (by two 64-bit sums of their hashes and their size) fall into one class with
one representative. Representatives get 128 minima: bands of them (21 of six for op9_minhash's 85 %, 25 of five
for the 80 % of the pipeline's stage) give candidates, and the two low bits of all minima are packed into four longs, from whose bit counts the similarity is estimated, corrected
for chance collisions, before any text moves.

A band's bucket never yields all its pairs. First each member is tested with the least and the greatest
member (a star); then only members that are still in different components, and whose estimate allows a link,
are tested: in buckets of SMALL members as pairs, in larger ones within tiles of two blocks of at most BLOCK
members, which send on only the links that join components. Members of a bucket's largest component aren't
tested with each other, so each of them goes to as many tiles as there are blocks of other members, which a
group of copies has few of. So connectivity is that of all candidate pairs.
Pairs that differ in size too much, or whose estimate is five standard deviations below the threshold, are
dropped.

Defined results: ids are whole numbers, and a doc_id that is none (a text, say) raises an error; a document
without words, or with a null text, has no set, links with nothing and is kept;
one with fewer than five words has its whole word sequence as only shingle; a null doc_id links with nothing
and is kept; rows with equal doc_id are one vertex; an empty table gives an empty result; only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded, cut, holding, joined
from quarry.llm.components import connected

WORDS, MINIMA, ROWS = 5, 128, 6
#: Similarity from which documents link, as a fraction of the union in percent: what op9_minhash asks for, and
#: what a stage without a contract of its own takes.
PERCENT, STAGE_PERCENT = 85, 80
#: Share of pairs at the threshold itself that may meet in no band.
MISS = 1e-4
#: Five standard deviations of the estimate below the threshold.
DEVIATIONS = 5.0
CACHE_WORDS = 250_000
SMALL, BLOCK, COLUMNS = 16, 256, 8192
_r = np.random.default_rng(20240501)
PLACE = _r.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
SALT = _r.integers(1, 1 << 63, WORDS, dtype=np.uint64)
A = _r.integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
B = _r.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return mixed((w * PLACE[:n]).sum(keepdims=True) + SALT[n])
    total = w[: n - WORDS + 1] * PLACE[0]
    for i in range(1, WORDS):
        total += w[i : n - WORDS + 1 + i] * PLACE[i]
    return np.unique(mixed(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (A[:, None] * x[None, at : at + 2048] + B[:, None]).min(axis=1), out=out)
    return out


LANES = np.uint64(2) * np.arange(32, dtype=np.uint64)
BAND_PLACE = _r.integers(1, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)


def layout(percent: int) -> tuple[int, int]:
    """Bands and minima in each: as many minima, up to ROWS, as let no more than MISS of the pairs at the threshold apart."""
    j = percent / 100
    rows = next((r for r in range(ROWS, 1, -1) if (1 - j**r) ** (MINIMA // r) <= MISS), 1)
    return MINIMA // rows, rows


def signature(hashes: np.ndarray, n_bands: int, n_rows: int) -> tuple:
    """Two sums over the set, band hashes, packed low bits; signed 64-bit."""
    m = minima(hashes).astype(np.uint64)
    n = n_bands * n_rows
    bands = mixed((m[:n] * BAND_PLACE[:n]).reshape(n_bands, n_rows).sum(axis=1) + np.arange(n_bands, dtype=np.uint64))
    packed = ((m & np.uint64(3)).reshape(4, 32) << LANES).sum(axis=1, dtype=np.uint64)
    sums = np.array([hashes.sum(dtype=np.uint64), mixed(hashes ^ SALT[0]).sum(dtype=np.uint64)])
    return sums.view(np.int64).tolist(), bands.view(np.int64).tolist(), packed.view(np.int64).tolist()


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, f1, f2, bands, p0..p3; bands and the rest are null where the set is empty."""
    n_bands, n_rows = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("minhash", _words.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(1):
                    found = shingles(text.as_py())
                    if len(found):
                        (f1, f2), bands, packed = signature(found, n_bands, n_rows)
                        rows.append((len(found), f1, f2, bands, *packed))
                    else:
                        rows.append((0, *[None] * 7))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.list_(pa.int64()) if i == 3 else pa.int64()) for i, c in enumerate(columns)]], ["doc_id", "n", "f1", "f2", "bands", "p0", "p1", "p2", "p3"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, f1 long, f2 long, bands array<long>, p0 long, p1 long, p2 long, p3 long")


def possible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and packed low bits of a and b allow the similarity."""
    low = 0x5555555555555555
    differ = [F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}")) for i in range(4)]
    lanes = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(low))) for x in differ[1:]), F.bit_count(differ[0].bitwiseOR(F.shiftrightunsigned(differ[0], 1)).bitwiseAND(F.lit(low))))
    estimate = ((1 - lanes / MINIMA) - 0.25) / 0.75
    return (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent) & (estimate >= least_possible(percent))


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "near-ids")
    texts = cut(docs.select("doc_id", "text").join(bounded(ids, ids.count(), 16), "doc_id", "left_semi"), "near-texts")
    a, b = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            good = []
            for a_text, b_text in zip(batch.column(2), batch.column(3), strict=True):
                if (text := a_text.as_py()) != last:
                    last, mine = text, shingles(text)
                other = shingles(b_text.as_py())
                common = len(np.intersect1d(mine, other, assume_unique=True))
                good.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    return pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def least_possible(percent: int) -> float:
    """The estimate five standard deviations below the threshold."""
    j = percent / 100
    m = 0.25 + 0.75 * j
    return j - DEVIATIONS * (m * (1 - m) / MINIMA) ** 0.5 / 0.75


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the shingles that two sets at least share."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[a:b], column[a:b] - at] = 1
        total += grid @ grid.T
    return total


def tile_links(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """rows: key, rep, root, size, n, p0..p3. Links (a, b) that join different roots, found in each bucket's
    tiles of two blocks; a tile sends on one less than its members at most.

    Blocks of the bucket's largest component have numbers below 0 and meet only those of other members.
    """
    ids = cut(rows.select(F.col("rep").alias("doc_id")).distinct(), "near-large")
    texts = docs.select("doc_id", "text").join(bounded(ids, ids.count(), 16), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("own"))
    main = cut(sizes.groupBy("key").agg(F.max(F.struct("own", "root")).alias("most"), F.sum("own").alias("all")).select("key", F.col("most.root").alias("main"), *[F.ceil(c / BLOCK).cast("int").alias(name) for c, name in ((F.col("most.own"), "n_main"), (F.col("all") - F.col("most.own"), "n_rest"))]), "near-main")
    in_main = F.col("root") == F.col("main")
    spread = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), n)).cast("int")
    blocks = joined(rows, main, "key").withColumn("block", F.when(in_main, -1 - spread(F.col("n_main"))).otherwise(spread(F.col("n_rest"))))
    others = F.explode(F.when(in_main, F.sequence(F.lit(0), F.col("n_rest") - 1)).otherwise(F.sequence(-F.col("n_main"), F.col("n_rest") - 1)))
    cells = blocks.withColumn("other", others)
    cells = joined(cells.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "rep", "root", "n", "p0", "p1", "p2", "p3"), cut(texts, "near-large-texts"), "rep")
    least = least_possible(percent)

    def run(table: pa.Table) -> pa.Table:
        rep, root, n = (table[c].to_numpy() for c in ("rep", "root", "n"))
        packed = [table[f"p{i}"].to_numpy().view(np.uint64) for i in range(4)]
        lanes = np.zeros((len(rep), len(rep)), np.int64)
        for p in packed:
            x = p[:, None] ^ p[None, :]
            lanes += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
        near = (((1 - lanes / MINIMA) - 0.25) / 0.75 >= least) & (root[:, None] != root[None, :])
        near &= np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent
        use = np.flatnonzero(near.any(axis=1))
        links = []
        if len(use):
            sets = [shingles(t) for t in table["text"].take(pa.array(use)).to_pylist()]
            size = np.array([len(s) for s in sets], np.float64)
            both = overlaps(sets)
            good = near[np.ix_(use, use)] & (100 * both >= percent * (size[:, None] + size[None, :] - both))
            group = {r: r for r in root[use].tolist()}

            def top(r: int) -> int:
                while group[r] != r:
                    group[r] = r = group[group[r]]
                return r

            for i, j in zip(*np.nonzero(np.triu(good)), strict=True):
                a, b = top(int(root[use[i]])), top(int(root[use[j]]))
                if a != b:
                    group[max(a, b)] = min(a, b)
                    links.append((int(rep[use[i]]), int(rep[use[j]])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return cells.groupBy("key", "first", "second").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(signatures(docs, percent), "near-signatures")
    sets = found.filter("n > 0 and doc_id is not null")
    reps = cut(sets.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), *[F.any_value(c).alias(c) for c in ("bands", "p0", "p1", "p2", "p3")]), "near-classes")
    classes = cut(reps.filter("members > 1").select("n", "f1", "f2", "rep"), "near-copies")
    members = joined(sets.select("doc_id", "n", "f1", "f2"), classes, ["n", "f1", "f2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    sketch = reps.select("rep", "n", "p0", "p1", "p2", "p3")
    keys = reps.select("rep", F.explode("bands").alias("key"))
    stars = cut(keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size")).filter("low < high"), "near-keys")
    buckets = cut(joined(keys, stars, "key"), "near-buckets")
    sides = buckets.select(F.col("low").alias("a"), F.col("rep").alias("b")).union(buckets.select("rep", "high")).filter("a < b").distinct()
    tested = sides.alias("e").join(sketch.alias("x"), F.col("e.a") == F.col("x.rep")).join(sketch.alias("y"), F.col("e.b") == F.col("y.rep")).filter(possible("x", "y", percent)).select("a", "b")
    tested = cut(tested.distinct(), "near-stars")
    # texts of one doc_id are one vertex
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("c")).filter("a < c")
    twins = members.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    links = cut(verified(tested, docs, percent).union(twins), "near-links")
    roots = connected(links)
    rest = buckets.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "size", F.coalesce("root", "rep").alias("root"))
    rest = cut(rest, "near-roots")
    mixed_keys = cut(rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key"), "near-mixed")
    open_rows = cut(joined(rest, mixed_keys, "key").join(sketch, "rep"), "near-open")
    few = open_rows.filter(F.col("size") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.root") != F.col("y.root")) & possible("x", "y", percent))
    fresh = across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    by_pair = verified(cut(fresh, "near-rest"), docs, percent)
    more = cut(by_pair.union(tile_links(open_rows.filter(F.col("size") > SMALL), docs, percent)), "near-more")
    roots = connected(links.union(more))
    rep_root = roots.withColumnRenamed("id", "rep")
    parts = members.join(rep_root, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = found.select("doc_id", F.col("n").alias("n_shingles")).join(parts, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The documents that are kept, with the columns of docs. Of several rows with one doc_id, the one with
    the least text stays, if any does."""
    found = cut(near_duplicates(docs, percent), "near-found")
    names = docs.columns
    at = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*at.values()).withColumn("id", F.col(at["doc_id"]).cast("long"))
    dropped = cut(found.filter("not kept").select(F.col("doc_id").alias("id")).distinct(), "near-dropped")
    rows = plain.join(bounded(dropped, dropped.count(), 16), "id", "left_anti")
    repeated = cut(found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().filter("count > 1").select("id"), "near-repeated")
    if n := repeated.count():
        again = bounded(repeated, n, 16)
        # the least text by an aggregate that is summed up before it moves; equal rows are one
        text, own = at["text"], [F.col(c) for c in at.values()]
        several = rows.join(again, "id", "left_semi")
        first = several.groupBy("id").agg(F.min_by(F.struct(*own), F.struct(F.col(text).isNotNull().alias("there"), F.col(text).alias("text"), F.to_json(F.struct(*own)).alias("rest"))).alias("least")).select("id", "least.*")
        rows = rows.join(again, "id", "left_anti").unionByName(first)
    return rows.select(*at.values()).toDF(*names)
