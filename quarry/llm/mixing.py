"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream of words: its documents in seeded hash order, read again from the start where the
target exceeds it. Streams are cut into blocks of equally many words. A slot of the schedule holds one block.
The golden-ratio sequence (slot * g) mod n_slots, with g next to n_slots / golden ratio and coprime to it,
runs through the cumulative block quotas; since it is a permutation, every source gets exactly its quota of
slots, spread evenly. A source's slots are ranked, and rank k carries block k of the source's stream; the
last block ends where the target does. Everything is DataFrame expressions.

Rows that are equal in doc_id, source and text are numbered as one group, whose words follow each other, and are
told apart again afterwards, so that no group meets in one task. Sources are ordered in ranges.

Defined results: a null text has size 0; null is a source of its own and comes last; documents of size 0
are kept and give nothing; repeated rows are documents of their own; an empty table gives an empty mix; only
doc_id, text and source are read, so the names of other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut, joined, row_hash, running

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a hash bucket within which positions are numbered, slots of a stretch, cells of the slot lookup,
#: repeated rows that a task tells apart at once.
BUCKET_ROWS, STRETCH, CELLS, COPIES = 1024, 4096, 4096, 4096
#: The schedule has about so many slots for each source at least; a block has BLOCK_WORDS words at most.
MIN_SLOTS, BLOCK_WORDS = 4096, 65_536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, n_sources: int, total: Column, cap: float) -> DataFrame:
    """sources: src, size, weight, one row each. Adds target: weights' shares of total, none above cap * size.

    With sources in order of cap * size / weight, the first ones are at their cap; each level is what is
    left for the others by unit of weight, so no iteration is needed.
    """
    order = [F.col("size") / F.col("weight"), F.col("src").asc_nulls_last()]
    ranked = running(sources.withColumn("weight", F.col("weight").cast("double")), n_sources, order, ["size", "weight"])
    weights = sources.agg(F.sum(F.col("weight").cast("double"))).first()[0] or 0.0
    level = (total - cap * F.col("before_size")) / (F.lit(weights) - F.col("before_weight"))
    ranked = ranked.withColumn("level", level)
    found = ranked.filter(F.col("level") * F.col("weight") <= cap * F.col("size")).agg(F.min_by("level", "rn")).first()[0]
    open_level = F.lit(found).cast("double")
    at_cap = cap * F.col("size")
    return ranked.withColumn("target", F.least(F.coalesce(open_level * F.col("weight"), at_cap), at_cap)).drop("level", "rn", "before_size", "before_weight")


def prefix(sums: DataFrame, at: str, value: str) -> DataFrame:
    """sums: src, at (from 0), value, one row for each place. Adds base: the values of a source's places before,
    in two steps, so that no task gets more than STRETCH places, or one of STRETCH times as many."""
    parted = sums.withColumn("high", F.expr(f"{at} div {STRETCH}"))
    high = parted.groupBy("src", "high").agg(F.sum(value).alias("sum"))
    high = high.withColumn("high_base", F.sum("sum").over(W.partitionBy("src").orderBy("high")) - F.col("sum"))
    low = F.sum(value).over(W.partitionBy("src", "high").orderBy(at)) - F.col(value)
    same = F.col("l.src").eqNullSafe(F.col("h.src")) & (F.col("l.high") == F.col("h.high"))
    return parted.withColumn("low_base", low).alias("l").join(high.alias("h"), same).select(*[f"l.{c}" for c in sums.columns], (F.col("low_base") + F.col("high_base")).alias("base"))


def positions(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """docs: doc_id, src, size, text_hash; sources: src, rows. Adds bucket, rn, copy (which identify the row) and
    start, the first word's place in the source's stream. Buckets are bounded, so that a large source is spread
    over many tasks."""
    groups = docs.groupBy("doc_id", "src", "size", "text_hash").agg(F.count("*").alias("n"))
    buckets = sources.select(F.col("src").alias("own"), F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"))
    spread = joined(groups, buckets, F.col("src").eqNullSafe(F.col("own"))).withColumn("h", row_hash("doc_id", "text_hash", seed=seed)).withColumn("bucket", F.shiftrightunsigned("h", 1) % F.col("buckets")).drop("own", "buckets")
    sums = prefix(spread.groupBy("src", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "bucket", "words")
    order = W.partitionBy("src", "bucket").orderBy("h", "doc_id", "text_hash")
    words = F.col("size") * F.col("n")
    numbered = spread.withColumn("rn", F.row_number().over(order)).withColumn("within", F.sum(words).over(order.rowsBetween(W.unboundedPreceding, 0)) - words)
    placed = numbered.alias("d").join(sums.alias("s"), F.col("d.src").eqNullSafe(F.col("s.src")) & (F.col("d.bucket") == F.col("s.bucket")))
    placed = placed.select("d.doc_id", "d.src", "d.size", "d.text_hash", "d.n", "d.bucket", "d.rn", (F.col("within") + F.col("base")).alias("start"))
    placed = cut(placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))), "mix-positions")
    if (placed.agg(F.max("piece")).first()[0] or 0) > 0:  # repeated rows in numbers: their pieces go to other tasks
        placed = placed.repartition("bucket", "rn", "piece")
    copies = F.explode(F.sequence(F.col("piece") * COPIES, F.least((F.col("piece") + 1) * COPIES, "n") - 1))
    return placed.withColumn("copy", copies).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("piece", "n")


def schedule(quotas: DataFrame, n_slots: int) -> DataFrame:
    """quotas: src, quota, base (sum of the quotas before). One row per slot: slot, src, block."""
    spark = quotas.sparkSession
    step = max(1, round(n_slots * (math.sqrt(5) - 1) / 2))
    while math.gcd(step, n_slots) > 1:
        step += 1
    width = max(1, math.ceil(n_slots / CELLS))
    # decimal: slot * step passes 64 bits where the schedule has over 2^31 slots
    wide = F.col("slot").cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)") if n_slots > 1 << 31 else F.col("slot") * F.lit(step)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("point", (wide % F.lit(n_slots)).cast("long")).withColumn("cell", F.expr(f"point div {width}"))
    cells = quotas.filter("quota > 0").withColumn("cell", F.explode(F.sequence(F.expr(f"base div {width}"), F.expr(f"(base + quota - 1) div {width}"))))
    owned = slots.join(cells, "cell").filter("point >= base and point < base + quota").select("slot", "src", F.expr(f"slot div {STRETCH}").alias("stretch"))
    counts = prefix(owned.groupBy("src", "stretch").agg(F.count("*").alias("n")), "stretch", "n").withColumnRenamed("base", "before")
    ranked = owned.withColumn("within", F.row_number().over(W.partitionBy("src", "stretch").orderBy("slot")))
    return ranked.alias("r").join(counts.alias("c"), F.col("r.src").eqNullSafe(F.col("c.src")) & (F.col("r.stretch") == F.col("c.stretch"))).select("slot", F.col("r.src").alias("src"), (F.col("within") + F.col("before") - 1).alias("block"))


def mix(docs: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1, 2, 3), seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The documents with their targets, and the mix.

    First: doc_id, src, size, source_size, target, bucket, rn, copy, start. Second: one row per document and
    slot that reads from it: slot, src, bucket, rn, copy, pass, first (word of the document), words.
    """
    sized = cut(docs.select("doc_id", F.col("source").alias("src"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    by_source = cut(sized.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "mix-sources")
    total, n_sources = by_source.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    by_name = [F.col("src").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = running(by_source, n_sources, by_name, []).withColumn("weight", weight).drop("rn")
    block = max(1, min(BLOCK_WORDS, total // (MIN_SLOTS * max(1, n_sources))))
    shares = targets(cut(weighted, "mix-weights"), n_sources, F.lit(float(total)), cap)
    shares = shares.withColumn("take", F.floor(F.col("target") + 1e-6)).withColumn("quota", F.ceil(F.col("take") / block).cast("long"))
    shares = cut(running(cut(shares, "mix-targets"), n_sources, by_name, ["quota"]).withColumnRenamed("before_quota", "base").drop("rn"), "mix-shares")
    n_slots = shares.agg(F.sum("quota")).first()[0] or 0
    of_source = shares.select(F.col("src").alias("own"), F.col("size").alias("source_size"), "target", "take")
    placed = joined(positions(sized, by_source, seed), of_source, F.col("src").eqNullSafe(F.col("own"))).drop("own")
    placed = cut(placed.select("doc_id", "src", "size", "text_hash", "source_size", "target", "take", "bucket", "rn", "copy", "start"), "mix-placed")
    # a document's pieces: the blocks of each pass that hold words of it
    runs = placed.filter("size > 0 and take > start").withColumn("pass", F.explode(F.sequence(F.lit(0), F.least(F.expr("(take - start - 1) div source_size"), F.lit(math.ceil(cap) - 1)).cast("int"))))
    runs = runs.withColumn("from", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take")))
    pieces = runs.withColumn("block", F.explode(F.sequence(F.expr(f"from div {block}"), F.expr(f"(to - 1) div {block}"))))
    met = pieces.alias("p").join(schedule(shares, n_slots).alias("s"), F.col("p.src").eqNullSafe(F.col("s.src")) & (F.col("p.block") == F.col("s.block")))
    begin, end = F.greatest(F.col("from"), F.col("p.block") * block), F.least(F.col("to"), (F.col("p.block") + 1) * block)
    return placed, met.select("slot", F.col("p.src").alias("src"), "bucket", "rn", "copy", "pass", (begin - F.col("from")).alias("first"), (end - begin).alias("words"))


ROW = ["bucket", "rn", "copy"]


def same_row(a: str, b: str) -> Column:
    on = F.col(f"{a}.src").eqNullSafe(F.col(f"{b}.src"))
    for c in ROW:
        on &= F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    return on


def taken(docs: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """For each document: doc_id, size, source_size, target, taken, source."""
    placed, mixed = mix(docs, cap, weights, seed)
    sums = mixed.groupBy("src", *ROW).agg(F.sum("words").alias("taken"))
    return placed.alias("d").join(sums.alias("m"), same_row("d", "m"), "left").select("doc_id", "d.size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("d.src").alias("source"))


def mixed_documents(docs: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mix in whole documents, with the columns of docs: a copy for each scheduled block that begins a
    document's words. Documents whose first word no block takes are left out; those of size 0 too.

    Rows equal in doc_id, source and text share their copies, the first ones of a written order taking one more.
    """
    names = docs.columns
    at = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*at.values()).withColumn("hash", F.xxhash64(at["text"]))
    placed, mixed = mix(docs.select(*[F.col(f"`{c}`") for c in ("doc_id", "text", "source")]), cap, weights, seed)
    copies = mixed.filter("first = 0").groupBy("src", *ROW).agg(F.count("*").alias("copies"))
    per_row = placed.alias("d").join(copies.alias("c"), same_row("d", "c"), "left").groupBy(F.col("doc_id").alias("id"), F.col("d.src").alias("of"), F.col("text_hash").alias("text_hash")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keys = cut(per_row.filter("copies > 0"), "mix-copies")
    same = F.col(at["doc_id"]).eqNullSafe(F.col("id")) & F.col(at["source"]).eqNullSafe(F.col("of")) & (F.col("hash") == F.col("text_hash"))
    own = list(at.values())
    # there are as many keys as documents: they are shuffled at every size
    once = plain.join(keys.filter("rows = 1").hint("shuffle_merge"), same).withColumn("share", F.col("copies"))
    several = keys.filter("rows > 1")
    if not several.isEmpty():
        # numbered within stretches of the written table, and those added up
        twins = cut(plain.join(several.hint("shuffle_merge"), same).withColumn("uid", F.monotonically_increasing_id()), "mix-twins")
        key = ["id", "of", "text_hash"]
        parted = twins.withColumn("stretch", F.expr(f"uid div {COPIES}"))
        before = parted.groupBy(*key, "stretch").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy(*key).orderBy("stretch")) - F.col("n"))
        numbered = parted.withColumn("k", F.row_number().over(W.partitionBy(*key, "stretch").orderBy("uid")))
        alike = F.col("l.stretch") == F.col("r.stretch")
        for c in key:
            alike &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        ranked = numbered.alias("l").join(before.select(*key, "stretch", "before").alias("r"), alike).select("l.*", (F.col("l.k") + F.col("r.before")).alias("rank"))
        share = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("rank") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
        once = once.select(*own, "share").unionByName(ranked.withColumn("share", share).select(*own, "share"))
    return once.filter("share > 0").withColumn("times", F.explode(F.sequence(F.lit(1), F.col("share").cast("int")))).select(*own).toDF(*names)
