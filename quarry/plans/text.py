"""Queries over sources, text functions and tables, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, inventory, quality, table_chunks, tables


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: the path is made of source, language and id."""
    docs = read(spark, sf_dir, "documents")
    return inventory.identified(docs.select("doc_id", "text", "source", F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path")))


FILES = "files AS (SELECT doc_id, text, source, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, sha256(coalesce(text, '')) AS source_sha256, substr(sha256(coalesce(text, '')), 1, 16) AS source_id FROM documents)"


def dup_groups(spark, d):
    return inventory.duplicate_groups(source_files(spark, d)).select("source_id", "duplicate_group_size", "canonical", F.array_join("aliases", ",").alias("aliases"))


def canonical_docs(spark, d):
    return inventory.canonical(source_files(spark, d)).select("source_id", "doc_id", "path")


def canonical_with_policy(spark, d):
    files = source_files(spark, d)
    # the policy prefers the largest path of each group that has a quality label
    labelled = files.join(read(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id")
    policy = labelled.groupBy("source_id").agg(F.max("path").alias("preferred_path"))
    return inventory.canonical(files, policy=policy).select("source_id", "doc_id", "path", "preferred_path")


def id_collision_guard(spark, d):
    return inventory.id_collisions(source_files(spark, d))


def inventory_by_source(spark, d):
    files = source_files(spark, d)
    return files.groupBy("source").agg(F.count("*").alias("n_files"), F.count_distinct("source_id").alias("n_contents"), F.sum(F.octet_length("text")).alias("n_bytes"))


def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("normalized"))


def compact_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(T.compact_text(F.col("text")), 256).alias("compact"))


def leader_dots(spark, d):
    line = F.concat("p_name", F.repeat(F.lit("."), (F.col("p_size") % 9)), F.lit(" "), F.repeat(F.lit("·"), (F.col("p_size") % 7)), F.col("p_size").cast("string"))
    return read(spark, d, "part").select("p_partkey", T.collapse_leader_dots(line).alias("line"))


def embedding_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(T.embedding_text(F.col("text")), 256).alias("embedding_text"), F.length("text").cast("long").alias("n"))


def alnum_count(spark, d):
    return read(spark, d, "documents").select("doc_id", T.alnum_count(F.col("text")).alias("n_alnum"))


def escape_cell(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(T.escape_cell(F.col("html")), 256).alias("cell"))


def neutralize_tags(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(T.neutralize_tags(F.concat(F.col("html"), F.lit("<TABLE><tr ><td x=1>a</td></tr></table><b>b</b><img src=x><br/><tfoot><col><table"))), 256).alias("html"))


def escape_html(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("escaped"))


def heading_detect(spark, d):
    leads = ["Ⅳ. ", "제 2 장 ", "- ", "IV. ", "Ⅹ) ", "Ⅰ", "제3장"]
    lead = F.element_at(F.array(*map(F.lit, leads)), (F.col("p_size") % len(leads) + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", T.heading_of(F.concat(F.lit("\n\nx\n"), lead, "p_name", F.lit("\nⅥ late  one\nⅩ. later"))).alias("heading"))


def page_marker(spark, d):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("- "), n, F.lit(" -"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("– "), n, F.lit(" –"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("- "), n, F.lit(" - - "), (F.col("p_size") + 1).cast("string"), F.lit(" -"))).otherwise(F.concat(F.lit("- "), n, F.lit(" - - "), (F.col("p_size") + 2).cast("string"), F.lit(" -")))
    return read(spark, d, "part").select("p_partkey", F.array_join(T.page_marker(text), ",").alias("pages"))


def context_prefix(spark, d):
    docs = read(spark, d, "documents")
    named = F.array(F.concat(F.lit("source: "), F.nullif("source", F.lit(""))), F.concat(F.lit("lang: "), F.nullif("lang", F.lit(""))))
    return docs.select("doc_id", F.array_join(F.filter(named, lambda x: x.isNotNull()), "\n").alias("prefix"))


def strategy_ids(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.lit(T.strategy_id(512, T.default_overlap(512))).alias("strategy_id"), chunking.chunk_id(F.substring(F.sha2("text", 256), 1, 16), 512, 51, F.lit(1)).alias("first_chunk_id"))


def metadata_scalarize(spark, d):
    docs = read(spark, d, "documents")
    pairs = F.map_from_arrays(F.array(F.lit("lang"), F.lit("source"), F.lit("odd")), F.array("lang", "source", F.when(F.col("doc_id") % 2 == 1, "").otherwise("even")))
    kept = F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
    return docs.select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("metadata"))


def truncate_preview(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(T.truncated(F.col("text")), 256).alias("preview"))


def split_ids(spark, d):
    joined = F.concat_ws(" | ", F.col("doc_id").cast("string"), F.lit(""), "lang", F.lit("  "), "source")
    ids = T.split_ids(joined)
    return read(spark, d, "documents").select("doc_id", F.size(ids).cast("long").alias("n_ids"), F.array_join(ids, ",").alias("ids"))


def extract_json(spark, d):
    # whole events, their properties and all, between words and fences
    answer = F.concat(F.lit('Sure [1]: ```json\n{"id": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('", "of": [{"a": 1}]}\n```'))
    return read(spark, d, "events").select("event_id", T.json_in(answer, "id long, kind string").alias("j")).select("event_id", "j.id", "j.kind")


def event_props(spark, d):
    """Typed columns of the JSON properties."""
    rows = read(spark, d, "events")
    return rows.select("event_type", F.try_parse_json("props").isNotNull().alias("ok")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_parsed"))


def render_gfm(spark, d):
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tables.gfm(rows, ["r_name"], "n_nationkey", ["n_nationkey", "n_name"])


def markdown_to_plain(spark, d):
    plain = T.plain_table(F.concat(F.lit("caption\n"), F.col("markdown"), F.lit("\n![x](image://1)\n| - | |")))
    return render_gfm(spark, d).select("r_name", plain.alias("plain"))


def table_lines(spark, d):
    """The Markdown tables of all regions, with a caption before and a note after."""
    text = F.concat(F.lit("caption\n"), F.col("markdown"), F.lit("\nnote\n| lone |"))
    lines = render_gfm(spark, d).select("r_name", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines


def markdown_segments(spark, d):
    return tables.segments(table_lines(spark, d), "r_name")


def span_fill_grid(spark, d):
    cells = read(spark, d, "part").select("p_partkey", (F.col("p_size") % 3 + 1).alias("row"), (F.col("p_size") % 2 + 1).alias("col"), (F.col("p_size") % 2 + 1).alias("row_span"), (F.col("p_size") % 4 + 1).alias("col_span"), F.col("p_brand").alias("value"))
    return tables.filled(cells, "p_partkey")


def grid_exact_cover(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row"), F.lit(1).alias("col"), (F.col("l_linenumber") % 2 + 1).alias("row_span"), F.lit(2).alias("col_span"), F.col("l_returnflag").alias("value"))
    return tables.exact_cover(tables.filled(lines, "l_orderkey"), "l_orderkey")


def words(spark, d):
    """Line items as words on a page: the order is the page, part and supplier are the place."""
    rows = read(spark, d, "lineitem")
    return rows.select("l_orderkey", F.col("l_linenumber").alias("word_id"), (F.col("l_partkey") % 600).cast("double").alias("x"), (F.col("l_suppkey") % 90).cast("double").alias("y"))


def word_in_bbox(spark, d):
    boxes = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("box_id"), (F.col("l_linenumber") * 40.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_linenumber") * 40.0 + F.col("l_quantity") * 6).alias("x1"), (F.col("l_quantity") * 2).alias("y1"))
    return tables.words_in_boxes(words(spark, d), boxes, "l_orderkey")


def lines_from_words(spark, d):
    return tables.text_lines(words(spark, d), "l_orderkey").groupBy("l_orderkey", "line_no").agg(F.count("*").alias("n_words"), F.min("y").alias("top"))


def cluster_edges(spark, d):
    edges = words(spark, d).groupBy("l_orderkey").agg(tables.edge_clusters(F.collect_list("x"), 50.0).alias("edges"))
    return edges.select("l_orderkey", F.size("edges").cast("long").alias("n_edges"), F.round(F.aggregate("edges", F.lit(0.0), lambda a, x: a + x), 2).alias("sum_edges"))


def table_row_pack(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("size"))
    return tables.packed_rows(rows, "l_orderkey", "l_linenumber", "size", limit=80, header=10)


def gate_unique(spark, d):
    return quality.unique(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def gate_contiguity(spark, d):
    return quality.contiguity(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def gate_fk(spark, d):
    return quality.orphans(read(spark, d, "labels"), read(spark, d, "documents"), "doc_id", "doc_id").select("doc_id")


def table_segments_chunked(spark, d):
    """Each order's lines as a table, in parts of at most 160 tokens with up to 22 of the part before, that is, one row
    at most; several are left to the tests of the operator."""
    lines = read(spark, d, "lineitem")
    made = tables.gfm(lines, ["l_orderkey"], "l_linenumber", ["l_linenumber", "l_partkey", "l_suppkey"])
    blocks = made.select(F.col("l_orderkey").alias("key"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("prefix"), "markdown")
    out = table_chunks.chunked(blocks, 160, 22)
    return out.select(F.col("key").alias("l_orderkey"), "part_no", "part_count", "row_start", "row_end", "size", "overlap_mode", "overlap", F.md5("text").alias("text_md5"))


def gate_rules(spark, d):
    docs = read(spark, d, "documents")
    return quality.violations(docs, n_without_text=F.trim("text") != "", n_wrong_length=F.length("text") == F.col("n_chars"), n_replaced=~F.contains("text", F.lit("�")), n_payload=~F.rlike("text", F.lit("data:image/[a-z]+;base64")))


def gate_singletons(spark, d):
    return quality.singletons(read(spark, d, "documents"), "lang", "source")


def set_difference(spark, d):
    return quality.difference(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


TAGGED = r"""regexp_replace(regexp_replace({x}, '(?i)<(/?(?:table|thead|tbody|caption|tr|th|td|img|p|li|br|script|style|iframe)\b[^<>]*)>', '&lt;\1&gt;', 'g'), '(?i)<(/?(?:table|thead|tbody|caption|tr|th|td|img|p|li|br|script|style|iframe)\b)', '&lt;\1', 'g')"""
NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[·․‧∙⋅]{5,}|\.{5,}', ' ', 'g'), '(?m)[ \t\x0B\f]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"""
CELL = r"""replace(replace(regexp_replace(""" + NORMAL.replace("(text,", "({x},").replace("{5,}", "{{5,}}").replace("{3,}", "{{3,}}") + r""", '\n+', ' / ', 'g'), '\', '\\'), '|', '\|')"""
GFM = r"""gfm AS (SELECT r_name, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)"""
WORDS = "words AS (SELECT l_orderkey, l_linenumber AS word_id, CAST(l_partkey % 600 AS DOUBLE) AS x, CAST(l_suppkey % 90 AS DOUBLE) AS y FROM lineitem)"

SQL = {
    "dup_groups": f"WITH {FILES} SELECT source_id, count(*) AS duplicate_group_size, min(lower(path)) AS canonical, string_agg(path, ',' ORDER BY path) AS aliases FROM files GROUP BY source_id",
    "canonical_docs": f"WITH {FILES} SELECT source_id, doc_id, path FROM files QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY lower(path), path) = 1",
    "canonical_with_policy": f"WITH {FILES}, policy AS (SELECT source_id, max(path) AS preferred_path FROM files JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source_id) SELECT source_id, doc_id, path, preferred_path FROM files LEFT JOIN policy USING (source_id) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY coalesce(path <> preferred_path, true), lower(path), path) = 1",
    "id_collision_guard": f"WITH {FILES} SELECT source_id, count(DISTINCT source_sha256) AS n FROM files GROUP BY source_id HAVING n > 1",
    "inventory_by_source": f"WITH {FILES} SELECT source, count(*) AS n_files, count(DISTINCT source_id) AS n_contents, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM files GROUP BY source",
    "normalize_text": f"SELECT doc_id, sha256({NORMAL}) AS normalized FROM documents",
    "compact_text": rf"SELECT doc_id, sha256(trim(regexp_replace({NORMAL}, '\s+', ' ', 'g'))) AS compact FROM documents",
    "leader_dots": r"SELECT p_partkey, regexp_replace(p_name || repeat('.', p_size % 9) || ' ' || repeat('·', p_size % 7) || p_size, '[·․‧∙⋅]{5,}|\.{5,}', ' ', 'g') AS line FROM part",
    "embedding_text": "SELECT doc_id, sha256(translate(text, chr(10) || chr(13) || chr(11) || chr(12) || chr(133) || chr(8232) || chr(8233), '       ')) AS embedding_text, length(text) AS n FROM documents",
    "alnum_count": r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n_alnum FROM documents",
    "escape_cell": f"SELECT page_id, sha256({TAGGED.format(x=CELL.format(x='html'))}) AS cell FROM pages",
    "neutralize_tags": "SELECT page_id, sha256(" + TAGGED.format(x="html || '<TABLE><tr ><td x=1>a</td></tr></table><b>b</b><img src=x><br/><tfoot><col><table'") + ") AS html FROM pages",
    "escape_html": "SELECT page_id, sha256(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')) AS escaped FROM pages",
    "heading_detect": r"WITH t AS (SELECT p_partkey, unnest(['x', ['Ⅳ. ', '제 2 장 ', '- ', 'IV. ', 'Ⅹ) ', 'Ⅰ', '제3장'][p_size % 7 + 1] || p_name, 'Ⅵ late  one', 'Ⅹ. later']) AS line, unnest([1, 2, 3, 4]) AS place FROM part), c AS (SELECT p_partkey, place, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM t WHERE place <= 3) SELECT p_partkey, arg_min(line, place) FILTER (WHERE length(line) <= 200 AND regexp_matches(line, '^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|제\s*\p{Nd}+\s*장)\s*[.)]?\s*.+$')) AS heading FROM c GROUP BY p_partkey",
    "page_marker": "SELECT p_partkey, CASE WHEN p_size NOT BETWEEN 1 AND 999 THEN NULL WHEN p_partkey % 4 < 2 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 4 = 2 THEN p_size || ',' || (p_size + 1) END AS pages FROM part",
    "context_prefix": "SELECT doc_id, concat_ws(chr(10), 'source: ' || nullif(source, ''), 'lang: ' || nullif(lang, '')) AS prefix FROM documents",
    "strategy_ids": "SELECT doc_id, 'naive_fixed_512_51' AS strategy_id, substr(sha256(text), 1, 16) || ':N512O51:C000001' AS first_chunk_id FROM documents",
    "metadata_scalarize": "SELECT doc_id, concat_ws(';', 'lang=' || nullif(lang, ''), CASE WHEN doc_id % 2 = 0 THEN 'odd=even' END, 'source=' || nullif(source, '')) AS metadata FROM documents",
    "truncate_preview": "SELECT doc_id, sha256(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END) AS preview FROM documents",
    "split_ids": "SELECT doc_id, 1 + CAST(coalesce(lang, '') <> '' AS BIGINT) + CAST(coalesce(source, '') <> '' AS BIGINT) AS n_ids, concat_ws(',', doc_id, nullif(lang, ''), nullif(source, '')) AS ids FROM documents",
    "extract_json": r"""WITH a AS (SELECT event_id, 'Sure [1]: ```json' || chr(10) || '{"id": ' || event_id || ', "kind": "' || event_type || '", "of": [{"a": 1}]}' || chr(10) || '```' AS t FROM events), j AS (SELECT event_id, regexp_extract(t, '(?s)\{.*\}') AS j FROM a) SELECT event_id, CAST(json_extract(j, '$.id') AS BIGINT) AS id, json_extract_string(j, '$.kind') AS kind FROM j""",
    "event_props": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_valid(props)) AS n_parsed FROM events GROUP BY event_type",
    "render_gfm": f"WITH {GFM} SELECT * FROM gfm",
    "markdown_to_plain": "SELECT r_name, 'caption n_nationkey n_name ' || string_agg(n_nationkey || ' ' || n_name, ' ' ORDER BY n_nationkey) AS plain FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "markdown_segments": "WITH n AS (SELECT r_name, count(*) AS rows FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) SELECT r_name, s.segment_no, s.is_table, CASE s.segment_no WHEN 2 THEN rows + 2 ELSE 1 END AS n_lines, s.has_header FROM n CROSS JOIN (VALUES (CAST(1 AS BIGINT), false, CAST(0 AS BIGINT)), (2, true, 1), (3, false, 0), (4, true, 0)) AS s(segment_no, is_table, has_header)",
    "span_fill_grid": "SELECT p_partkey, CAST(p_size % 3 + 1 + r.i AS BIGINT) AS grid_row, CAST(p_size % 2 + 1 + c.i AS BIGINT) AS grid_col, p_brand AS value FROM part, (VALUES (0), (1)) AS r(i), (VALUES (0), (1), (2), (3)) AS c(i) WHERE r.i <= p_size % 2 AND c.i <= p_size % 4",
    "grid_exact_cover": "WITH g AS (SELECT l_orderkey, l_linenumber + r.i AS gr, 1 + c.i AS gc FROM lineitem, (VALUES (0), (1)) AS r(i), (VALUES (0), (1)) AS c(i) WHERE r.i <= l_linenumber % 2), p AS (SELECT l_orderkey, gr, gc, count(*) AS times FROM g GROUP BY ALL) SELECT l_orderkey, max(times) = 1 AND count(*) = (max(gr) - min(gr) + 1) * (max(gc) - min(gc) + 1) AS exact FROM p GROUP BY l_orderkey",
    "word_in_bbox": f"WITH {WORDS}, boxes AS (SELECT l_orderkey, l_linenumber AS box_id, l_linenumber * 40.0::DOUBLE AS x0, l_linenumber * 40.0::DOUBLE + l_quantity * 6 AS x1, l_quantity * 2 AS y1 FROM lineitem) SELECT w.l_orderkey, word_id, box_id FROM words w JOIN boxes b ON w.l_orderkey = b.l_orderkey AND x BETWEEN x0 AND x1 AND y BETWEEN 0 AND y1 QUALIFY row_number() OVER (PARTITION BY w.l_orderkey, word_id ORDER BY (x1 - x0) * y1, box_id) = 1",
    "lines_from_words": f"WITH {WORDS}, m AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY l_orderkey ORDER BY y, x, word_id) <= 3 THEN 0 ELSE 1 END AS new FROM words), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY l_orderkey ORDER BY y, x, word_id) AS BIGINT) AS line_no FROM m) SELECT l_orderkey, line_no, count(*) AS n_words, min(y) AS top FROM s GROUP BY ALL",
    "cluster_edges": f"WITH RECURSIVE {WORDS}, s AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS pos FROM words), f AS (SELECT l_orderkey, pos, x AS edge, true AS new FROM s WHERE pos = 1 UNION ALL SELECT s.l_orderkey, s.pos, CASE WHEN s.x - f.edge <= 50 THEN f.edge ELSE s.x END, s.x - f.edge > 50 FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.pos = f.pos + 1) SELECT l_orderkey, count(*) FILTER (WHERE new) AS n_edges, round(sum(edge) FILTER (WHERE new), 2) AS sum_edges FROM f GROUP BY l_orderkey",
    "table_row_pack": "WITH RECURSIVE s AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS pos FROM lineitem), f AS (SELECT l_orderkey, pos, 1 AS part, n AS total FROM s WHERE pos = 1 UNION ALL SELECT s.l_orderkey, s.pos, CASE WHEN f.total + s.n <= 70 THEN f.part ELSE f.part + 1 END, CASE WHEN f.total + s.n <= 70 THEN f.total + s.n ELSE s.n END FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.pos = f.pos + 1), p AS (SELECT l_orderkey, part, max(total) + 10 AS size FROM f GROUP BY ALL) SELECT l_orderkey, count(*) AS n_parts, string_agg(size, ',' ORDER BY part) AS part_sizes FROM p GROUP BY l_orderkey",
    "table_segments_chunked": "WITH RECURSIVE s AS (SELECT l_orderkey, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_suppkey || ' |' AS line, row_number() OVER w AS pos, coalesce(length(lag(l_linenumber || ' | ' || l_partkey || ' | ' || l_suppkey) OVER w) + 4, 0) AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_suppkey || ' |')), b AS (SELECT l_orderkey, 160 - length('order ' || l_orderkey) - 2 - length('| l_linenumber | l_partkey | l_suppkey |') - 1 - length('| --- | --- | --- |') AS room FROM s GROUP BY l_orderkey), f AS (SELECT l_orderkey, pos, 1 AS part, pos AS first, CAST(0 AS BIGINT) AS again, length(line) + 1 AS total FROM s WHERE pos = 1 UNION ALL SELECT s.l_orderkey, s.pos, CASE WHEN total + 1 + length(line) <= room THEN part ELSE part + 1 END, CASE WHEN total + 1 + length(line) <= room THEN first WHEN before <= 22 THEN s.pos - 1 ELSE s.pos END, CASE WHEN total + 1 + length(line) <= room THEN again WHEN before <= 22 THEN before ELSE 0 END, CASE WHEN total + 1 + length(line) <= room THEN total + 1 + length(line) WHEN before <= 22 THEN before + 1 + length(line) + 1 ELSE length(line) + 1 END FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.pos = f.pos + 1 JOIN b ON b.l_orderkey = s.l_orderkey), p AS (SELECT l_orderkey, part, min(first) AS row_start, max(pos) AS row_end, max(again) AS again FROM f GROUP BY ALL), t AS (SELECT p.l_orderkey, part, row_start, row_end, again, '| l_linenumber | l_partkey | l_suppkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text FROM p JOIN s ON s.l_orderkey = p.l_orderkey AND s.pos BETWEEN row_start AND row_end GROUP BY ALL) SELECT l_orderkey, CAST(part AS BIGINT) AS part_no, count(*) OVER (PARTITION BY l_orderkey) AS part_count, row_start, row_end, length('order ' || l_orderkey) + 2 + length(text) AS size, CASE WHEN part = 1 THEN 'none' WHEN again > 0 THEN 'whole_row_plus_header_repeat' ELSE 'header_repeat_only' END AS overlap_mode, again AS overlap, md5(text) AS text_md5 FROM t",
    "gate_unique": "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, count(*) FILTER (WHERE n > 1) AS n_repeated FROM g",
    "gate_contiguity": "SELECT l_orderkey, count(*) AS n_rows, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey",
    "gate_fk": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "gate_rules": "SELECT count(*) FILTER (WHERE NOT coalesce(trim(text) <> '', false)) AS n_without_text, count(*) FILTER (WHERE NOT coalesce(length(text) = n_chars, false)) AS n_wrong_length, count(*) FILTER (WHERE NOT coalesce(NOT contains(text, chr(65533)), false)) AS n_replaced, count(*) FILTER (WHERE NOT coalesce(NOT regexp_matches(text, 'data:image/[a-z]+;base64'), false)) AS n_payload FROM documents",
    "gate_singletons": "SELECT count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source FROM documents",
    "set_difference": "SELECT 'left' AS side, doc_id AS value FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)",
}

QUERIES = {name: globals()[name] for name in SQL}
