"""Personal data: patterns, and information-theoretic sanitisation of the terms that go with them.

Emails, addresses, cards and phone numbers are found by pattern and check. A document holds such an entity, or a
term (a word of at least four letters), if it occurs anywhere in its text. A term discloses an entity as far as
their pointwise mutual information, over all documents of the corpus, reaches the entity's information content:

    PMI(t; e) / IC(e) = ln(n_te * N / (n_t * n_e)) / ln(N / n_e)

with n_te documents that hold both, n_t that hold t, n_e that hold e, of N. From DISCLOSURE on, with SUPPORT
documents at least, all occurrences of the term are generalised in the documents that hold the entity. Everything
is DataFrame expressions.

Only pairs that can reach the threshold are counted. As n_te is n_e at most, a pair discloses only if

    n_t <= n_e * (N / n_e) ** (1 - DISCLOSURE)

and entities of the same documents are counted as one.

Defined results: a null text counts as empty; documents without an entity are left as they are; repeated rows are
documents of their own; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded, cut, fits, joined, sized
from quarry.llm.spans import apart, as_text, by_cell, located, matches, pieces, rewritten, values

DISCLOSURE, SUPPORT, LETTERS = 0.9, 2, 4
LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive forms of the patterns, linear in the text: a run of characters is tried from its start, or from the end of the last match, alone.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def may_hold(kind: str, text: Column) -> Column:
    if kind in ("email", "phone"):
        return F.contains(text, F.lit("@" if kind == "email" else "+"))
    return F.rlike(text, F.lit(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][ -]?[0-9]"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    figures = F.filter(F.split(F.reverse(digits(value)), ""), lambda c: c != "")
    doubled = F.transform(figures, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    n = F.length(digits(value))
    return F.when(kind == "ip", F.rlike(value, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))).when(kind == "card", F.when(n.between(13, 19), luhn(value)).otherwise(False)).when(kind == "phone", n.between(9, 15)).otherwise(True)


def scanned(docs: DataFrame) -> DataFrame:
    """uid, doc_id, the raw matches of each kind and, where one of them is an entity, the text, written once:
    later steps don't read all texts again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"), *[matches(pieces(text, PATTERNS[k], may_hold(k, text))).alias(k) for k in KINDS])
    of_kind = lambda k: F.exists(values(F.col(k)), lambda m: valid(F.lit(k), m["value"]))
    holds = reduce(Column.__or__, map(of_kind, KINDS))
    return cut(found.withColumn("text", F.when(holds, F.col("text"))).withColumn("uid", F.monotonically_increasing_id()), "pii-scan")


def entities(scan: DataFrame) -> DataFrame:
    """uid, place, kind, start, end, value of each base span."""
    return located(scan, KINDS).filter(valid(F.col("kind"), F.col("value")))


def of_documents(uid: str = "uid") -> list[Column]:
    """Two sums that tell sets of documents apart."""
    return [F.sum(F.xxhash64(F.lit(seed), uid).cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2)]


def held(base: DataFrame, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """The entities that terms may disclose, those of the same documents as one: uid, entity pairs, and entity,
    n_e, most (the documents that a term may occur in at most)."""
    entity = F.concat_ws(":", "kind", F.when(F.col("kind").isin("card", "phone"), digits(F.col("value"))).otherwise(F.lower("value")))
    pairs = cut(base.select("uid", entity.alias("entity")).distinct(), "pii-held")
    sizes = pairs.groupBy("entity").agg(F.count("*").alias("n_e"), *of_documents()).filter((F.col("n_e") >= SUPPORT) & (F.col("n_e") < n_docs))
    most = F.floor(F.col("n_e") * F.pow(F.lit(float(n_docs)) / F.col("n_e"), F.lit(1 - DISCLOSURE)) * (1 + 1e-9))
    first = cut(sizes.groupBy("n_e", "sum1", "sum2").agg(F.min("entity").alias("entity")).select("entity", "n_e", most.alias("most")), "pii-entities")
    return pairs.join(first.select("entity"), "entity", "left_semi"), first


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    words = F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= LETTERS)
    return F.array_distinct(F.transform(words, F.lower))


def frequencies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, n_t: in how many of all documents each of the given terms occurs, summed up before anything moves."""
    found = texts.select(F.explode(terms(F.col("text"))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi")


def disclosing(docs: DataFrame, texts: DataFrame, base: DataFrame, n_docs: int) -> DataFrame:
    """uid, term: the terms of each document that disclose an entity it holds.

    Terms of the same documents are counted as one, as entities are: copies of a document, however many and
    however long, add a row for each of them and class of terms, not for each term.
    """
    pairs, sizes = held(base, n_docs)
    of_doc = cut(pairs.join(sizes, "entity"), "pii-of-doc")
    uids = cut(of_doc.select("uid").distinct(), "pii-uids")
    there = cut(texts.join(bounded(uids, uids.count(), 16), "uid", "left_semi").select("uid", F.explode(terms(F.col("text"))).alias("term")), "pii-there")
    often = cut(there.groupBy("term").agg(F.count("*").alias("m_t"), *of_documents()).filter(F.col("m_t") >= SUPPORT), "pii-terms")
    widest = sizes.agg(F.max("most")).first()[0] or 0
    alike = ["n_t", "m_t", "sum1", "sum2"]
    known = cut(often.join(frequencies(docs, often.select("term")).filter(F.col("n_t") <= widest), "term"), "pii-frequencies")
    classes = cut(known.groupBy(*alike).agg(F.min("term").alias("class")), "pii-classes")
    first = classes.select(F.col("class").alias("term"), "n_t")
    both = cut(joined(there, first, "term").join(of_doc, "uid").filter(F.col("n_t") <= F.col("most")).select("uid", "entity", "n_e", "n_t", F.col("term").alias("class")), "pii-both")
    counts = both.groupBy("entity", "class").agg(F.count("*").alias("n_te"), F.any_value("n_t").alias("n_t"), F.any_value("n_e").alias("n_e"))
    share = F.log(F.col("n_te") * F.lit(float(n_docs)) / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(float(n_docs)) / F.col("n_e"))
    told = counts.filter((F.col("n_te") >= SUPPORT) & (share >= DISCLOSURE)).select("entity", "class")
    of_class = both.join(told, ["entity", "class"], "left_semi").select("uid", "class").distinct()
    return cut(of_class.join(known.join(classes, alike).select("class", "term"), "class").select("uid", "term"), "pii-told")


def occurrences(texts: DataFrame, told: DataFrame) -> DataFrame:
    """uid, start, end of each occurrence of a document's told terms."""
    uids = cut(told.select("uid").distinct(), "pii-told-uids")
    own = texts.join(bounded(uids, uids.count(), 16), "uid", "left_semi")
    words = own.select("uid", matches(pieces(F.col("text"), rf"(?<!\p{{L}})\p{{L}}{{{LETTERS},}}+", F.lit(True))).alias("word"))
    found = located(words, ["word"]).withColumn("term", F.lower("value"))
    return joined(found, told, ["uid", "term"], "left_semi").select("uid", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """uid, doc_id, base and more: the spans (place, kind, start, end) of each document, in order."""
    scan = scanned(docs)
    base = cut(entities(scan), "pii-base")
    texts = scan.filter("text is not null").select("uid", "text")
    told = disclosing(docs, texts, base, scan.count())
    extra = occurrences(texts, told).select("uid", F.lit(len(KINDS)).alias("place"), F.lit("term").alias("kind"), "start", "end")
    spans = apart(base.select("uid", "place", "kind", "start", "end").unionByName(extra), len(KINDS))
    span = F.struct(F.col("place").cast("int").alias("place"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind")
    by_doc = spans.groupBy("uid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    parts = by_doc.select("uid", F.filter("spans", lambda s: s["place"] < len(KINDS)).alias("base"), F.filter("spans", lambda s: s["place"] == len(KINDS)).alias("more"))
    none = F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string>>")
    return scan.select("uid", "doc_id", "text_hash").join(parts, "uid", "left").select("uid", "doc_id", "text_hash", F.coalesce("base", none).alias("base"), F.coalesce("more", none).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.concat("base", "more")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with entities and disclosing terms generalised, and n_chars, if there, counted anew.

    Spans come back to their document by doc_id and a hash of the text; equal rows have equal spans. Columns of
    docs are renamed by place meanwhile, so their names can't clash with the plan's.
    """
    names = docs.columns
    at = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*at.values())
    found = find(plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))).filter(F.size("base") > 0)
    first = found.groupBy("doc_id", "text_hash").agg(F.any_value(F.concat("base", "more")).alias("spans"))
    spans = first.select("doc_id", "text_hash", F.explode("spans").alias("s")).select("doc_id", "text_hash", "s.start", "s.end", F.concat(F.lit("<"), F.upper("s.kind"), F.lit(">")).alias("label"))
    plan = cut(by_cell(spans, "doc_id", "text_hash"), "pii-plan")
    side = F.broadcast(plan) if fits(sized(plan)) else plan.hint("shuffle_merge")
    both = plain.join(side, F.col(at["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.xxhash64(at["text"]) == F.col("text_hash")), "left")
    text = F.when(F.col("cells").isNull(), F.col(at["text"])).otherwise(rewritten(F.col(at["text"]), F.col("cells")))
    changed = both.select(*[text.alias(c) if n == "text" else c for n, c in at.items()])
    if "n_chars" in at:  # of the text as it is now: counted from the column, in a step of its own
        counted = F.length(at["text"]).cast(docs.schema["n_chars"].dataType)
        changed = changed.select(*[counted.alias(c) if n == "n_chars" else c for n, c in at.items()])
    return changed.toDF(*names)
