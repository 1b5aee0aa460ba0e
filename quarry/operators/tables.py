"""Tables: Markdown segments and rendering, span fill, geometry of words, cells and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import escape_cell

#: Points within which words share a line and edges are one.
LINE_TOLERANCE = 3.0
#: Words that one task sorts.
WORDS = 500_000


def gfm(rows: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """One Markdown table per group, from rows in order: group, markdown."""
    line = F.concat(F.lit("| "), F.array_join(F.array(*[escape_cell(F.col(c).cast("string")) for c in columns]), " | "), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'|'.join([' --- '] * len(columns))}|\n"
    body = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return rows.groupBy(*group).agg(F.concat(F.lit(head), F.array_join(F.transform(body, lambda r: r["line"]), "\n")).alias("markdown"))


def segments(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines: key, line_no, line. Runs of table lines and of other lines: key, segment_no, is_table, n_lines, has_header."""
    order = W.partitionBy(key).orderBy("line_no")
    typed = lines.withColumn("is_table", F.startswith(F.trim("line"), F.lit("|")))
    changed = F.coalesce((F.lag("is_table").over(order) != F.col("is_table")).cast("int"), F.lit(1))
    numbered = typed.withColumn("changed", changed).withColumn("segment_no", F.sum("changed").over(order).cast("long"))
    inner = numbered.withColumn("at", F.row_number().over(W.partitionBy(key, "segment_no").orderBy("line_no")))
    separator = F.col("is_table") & (F.col("at") == 2) & F.rlike("line", F.lit(r"^\|[ :|-]+\|$"))
    return inner.groupBy(key, "segment_no", "is_table").agg(F.count("*").alias("n_lines"), F.max(separator.cast("int")).cast("long").alias("has_header"))


def filled(cells: DataFrame, key: str) -> DataFrame:
    """cells: key, row, col, row_span, col_span, value. The value is repeated in each covered grid cell."""
    down = F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)
    across = F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)
    by_row = cells.select(key, "value", F.explode(down.cast("array<bigint>")).alias("grid_row"), across.alias("across"))
    return by_row.select(key, "grid_row", F.explode(F.col("across").cast("array<bigint>")).alias("grid_col"), "value")


def exact_cover(grid: DataFrame, key: str) -> DataFrame:
    """key, exact: whether each cell of the bounding grid is covered once."""
    per = grid.groupBy(key, "grid_row", "grid_col").agg(F.count("*").alias("times"))
    size = (F.max("grid_row") - F.min("grid_row") + 1) * (F.max("grid_col") - F.min("grid_col") + 1)
    return per.groupBy(key).agg(((F.max("times") == 1) & (F.count("*") == size)).alias("exact"))


def words_in_boxes(words: DataFrame, boxes: DataFrame, key: str, cell: float = 64.0) -> DataFrame:
    """words: key, word_id, x, y; boxes: key, box_id, x0, y0, x1, y1. The smallest box around each word's centre,
    the lowest id of equals. Boxes are dealt to grid cells, so that the range join is an equi-join."""
    by_cell = boxes.select("*", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))).alias("cell"))
    placed = words.withColumn("cell", F.floor(F.col("x") / cell))
    inside = placed.join(by_cell, [key, "cell"]).filter("x >= x0 and x <= x1 and y >= y0 and y <= y1")
    order = W.partitionBy(key, "word_id").orderBy((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), "box_id")
    return inside.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select(key, "word_id", "box_id")


def text_lines(words: DataFrame, key: str, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """words: key, word_id, x, y, word. Adds line_no: a word within tolerance of the one above shares its line.
    Words are counted and dealt to so many tasks that one sorts about WORDS of them, at any size."""
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // WORDS))
    words = words.repartition(parts, key)
    order = W.partitionBy(key).orderBy("y", "x", "word_id")
    new = F.when(F.col("y") - F.lag("y").over(order) <= tolerance, 0).otherwise(1)
    return words.withColumn("new", new).withColumn("line_no", F.sum("new").over(order).cast("long")).drop("new")


def edge_clusters(values: Column, tolerance: float) -> Column:
    """The first value of each cluster of sorted values: those within tolerance of the cluster's first."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), start, lambda a, x: F.when((F.size(a) > 0) & (x - F.element_at(a, -1) <= tolerance), a).otherwise(F.concat(a, F.array(x))))


def packed_rows(rows: DataFrame, key: str, order: str, size: str, limit: int, header: int) -> DataFrame:
    """Greedy packing of table rows below a repeated header: key, n_parts, part_sizes."""
    from quarry.operators.chunking import greedy_sizes

    sizes = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(size).cast("long").alias("n")))), lambda r: r["n"])
    packed = rows.groupBy(key).agg(greedy_sizes(sizes, limit - header).alias("parts"))
    return packed.select(key, F.size("parts").cast("long").alias("n_parts"), F.array_join(F.transform("parts", lambda n: (n + header).cast("string")), ",").alias("part_sizes"))
