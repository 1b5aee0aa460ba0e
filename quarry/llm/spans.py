"""Positions of regular-expression matches in whole texts, in DataFrame expressions.

A text is split at its matches in one pass of the expression. Lengths of the pieces, summed up in a window over
the document's own pieces, give the positions, and what overlaps what is read from running maxima over sorted
spans, so that work is linear in the text (and n log n in its matches) however many matches it has. No expression
over a whole text stands inside a lambda, where it would be evaluated for each match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARK, OTHER = "\x01", "\x02"
#: Code points of a cell: texts are rewritten cell by cell, so that no position is looked for from a text's start.
CELL = 1024


def pieces(text: Column, pattern: str, when: Column) -> Column:
    """Gap, match, gap, ..., gap. `when` is a cheap test that holds for all texts with a match."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}")
    return F.when(when, F.split(marked, MARK)).otherwise(F.array(text))


def matches(parts: Column) -> Column:
    """struct(length, value) of each piece, value of the matches alone. `parts` is named once, so it is made once."""
    return F.transform(parts, lambda p, i: F.struct(F.length(p).alias("length"), F.when(i % 2 == 1, p).alias("value")))


def values(found: Column) -> Column:
    """The matches of a column made by matches()."""
    return F.filter(found, lambda p: p["value"].isNotNull())


def located(table: DataFrame, kinds: list[str], *keep: str) -> DataFrame:
    """uid, *keep, place (of the kind in kinds), kind, start, end and value of each match in the columns `kinds`,
    which matches() made."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), F.col(k).alias("found")) for i, k in enumerate(kinds)]))
    by_kind = table.select("uid", *keep, each.alias("of")).filter(F.size("of.found") > 1).select("uid", *keep, "of.place", "of.kind", F.posexplode("of.found").alias("at", "piece"))
    rows = by_kind.select("uid", *keep, "place", "kind", "at", "piece.length", "piece.value")
    end = F.sum("length").over(W.partitionBy("uid", "place").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", end).filter("at % 2 = 1").select("uid", *keep, "place", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "value")


def apart(spans: DataFrame, n_base: int) -> DataFrame:
    """Of rows with uid, place, start, end: those of the first n_base places, and of the others those that overlap
    none of them."""
    base = F.col("place") < n_base
    up = W.partitionBy("uid").orderBy("start", "place", "end").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy("uid").orderBy(F.desc("start"), F.desc("place"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    sided = spans.withColumn("__before", F.max(F.when(base, F.col("end"))).over(up)).withColumn("__after", F.min(F.when(base, F.col("start"))).over(down))
    free = (F.coalesce("__before", F.col("start")) <= F.col("start")) & (F.coalesce("__after", F.col("end")) >= F.col("end"))
    return sided.filter(base | free).drop("__before", "__after")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_cell(spans: DataFrame, *key: str, size: int = CELL) -> DataFrame:
    """spans: *key, start, end, label of texts. One row per key with `cells`: for each cell of a text up to its last
    span, what to copy and what to put: (from, to, go_on, label), within the cell.

    Where spans overlap, the earlier one's label stands for what they share, and what reaches beyond it is
    replaced by its own.
    """
    order = W.partitionBy(*key).orderBy("start", F.desc("end"), "label")
    covered = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    free = spans.withColumn("done", covered).filter("end > done").withColumn("begin", F.greatest("start", "done"))
    cells = free.withColumn("cell", F.explode(F.sequence(F.expr(f"done div {size}"), F.expr(f"(end - 1) div {size}"))))
    first, after = F.col("cell") * size, (F.col("cell") + 1) * size
    within = lambda c: (c - first).cast("int")
    label = F.when((F.col("begin") >= first) & (F.col("begin") < after), F.col("label")).otherwise("")
    entry = F.struct(within(F.greatest("done", first)).alias("from"), within(F.least("begin", after)).alias("to"), within(F.least("end", after)).alias("go_on"), label.alias("label"))
    entries = cells.select(*key, "cell", entry.alias("entry")).groupBy(*key, "cell").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    dense = F.sort_array(F.collect_list(F.struct("cell", "entries")))
    return entries.groupBy(*key).agg(dense.alias("dense")).select(*key, F.transform("dense", lambda c: c["entries"]).alias("cells"))


def rewritten(text: Column, cells: Column, size: int = CELL) -> Column:
    """text with its spans replaced by their labels, by the plan that by_cell() made with this size."""
    part = lambda cell, a, b: F.substring(cell, a + 1, F.greatest(F.lit(0), b - a))

    def one(cell: Column, i: Column) -> Column:
        entries = F.get(cells, i)
        put = F.array_join(F.transform(entries, lambda e: F.concat(part(cell, e["from"], e["to"]), e["label"])), "")
        return F.when(entries.isNull(), cell).otherwise(F.concat(put, part(cell, F.element_at(entries, -1)["go_on"], F.lit(size))))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)), one), "")
