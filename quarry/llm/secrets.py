"""Secrets: patterns, and corpus-wide ownership of what they find.

Each candidate's hash is counted by distinct repositories (an owner's distinct texts, so that copies of a document
count once) and owners (sources) over the corpus, wherever the value stands: as a match of the patterns or bare.
Values of COPIED owners or more, or of WIDE repositories or more, are widely copied examples, or ordinary words;
the others look like live credentials of an owner. Bare copies of a live value are found too (kind `reuse`),
without the name or prefix that the patterns need: runs of the characters that a value may have, with and without
`.` and `=`, of SHORT characters or more. Everything is DataFrame expressions.

Defined results: a null text counts as empty; a null source is an owner of its own; repeated rows are documents
of their own; dots at the end of a value are left out when values are compared; bare copies of values shorter than
SHORT are not looked for; an empty table gives an empty result; only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, joined
from quarry.llm.spans import apart, as_text, located, matches, pieces

COPIED, WIDE, SHORT = 3, 20, 6
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]++", "hex": "(?<![0-9a-f])[0-9a-f]{24,}+"}
#: Bare values: whole runs, without dots at the end, and runs between dots and equals signs.
WIDER, NARROW = "A-Za-z0-9+/_.=-", "A-Za-z0-9+/_-"
BARE = {"run": rf"(?<![{WIDER}])[{WIDER}]{{{SHORT - 1},}}[A-Za-z0-9+/_=-]", "part": rf"(?<![{NARROW}])[{NARROW}]{{{SHORT},}}+"}
KINDS = list(PATTERNS)
WHEN = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}"}
KEY = ["h1", "h2"]


def document(docs: DataFrame) -> list[Column]:
    """What tells documents apart (rows equal in both have equal matches), and the owner."""
    return [docs["doc_id"], F.xxhash64("text").alias("text_hash"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("owner")]


def scanned(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text_hash, owner and the raw matches, written once: later steps don't match them again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*document(docs), *[matches(pieces(text, p, F.rlike(text, F.lit(WHEN[k])))).alias(k) for k, p in PATTERNS.items()])
    return cut(found.withColumn("uid", F.monotonically_increasing_id()), "secret-scan")


def secret(kind: Column, value: Column) -> Column:
    return F.when(kind == "assign", F.regexp_extract(value, ASSIGN, 1)).otherwise(value)


def valid(kind: Column, value: Column) -> Column:
    n = F.length(secret(kind, value))
    return F.when(kind == "assign", n >= 6).when(kind == "access", n >= 20).otherwise(n >= 24)


def hashes(value: Column) -> list[Column]:
    """128 bits of a value without dots at its end."""
    plain = F.rtrim(value, F.lit("."))
    return [F.xxhash64(F.lit(seed), plain).alias(name) for seed, name in enumerate(KEY)]


def bare(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text_hash, owner, h1, h2: the documents in which wanted values occur in any form."""
    runs = [F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(0)) for p in BARE.values()]
    tokens = docs.select(*document(docs), F.explode(F.array_distinct(F.concat(*runs))).alias("value"))
    return joined(tokens.select("doc_id", "text_hash", "owner", *hashes(F.col("value"))), wanted, KEY, "left_semi")


def ownership(*rows: DataFrame) -> DataFrame:
    """h1, h2, n_owners, n_repositories, live of rows with h1, h2, owner, text_hash."""
    own = [*KEY, "owner", "text_hash"]
    every = rows[0].select(own)
    for more in rows[1:]:
        every = every.union(more.select(own))
    counts = every.distinct().groupBy(*KEY, "owner").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    return counts.withColumn("live", (F.col("n_owners") < COPIED) & (F.col("n_repositories") < WIDE))


def of_document(left: DataFrame, right: DataFrame, how: str, *more: str) -> DataFrame:
    """left joined with a table that cut() wrote, on doc_id, which may be null, text_hash and `more`."""
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    for c in ("text_hash", *more):
        on &= F.col(f"l.{c}") == F.col(f"r.{c}")
    return joined(left.alias("l"), right.alias("r"), on, how)


def occurrences(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end of each bare value. hits: doc_id, text_hash, h1, h2."""
    keys = cut(hits.select("doc_id", "text_hash").distinct(), "secret-reused-in")
    texts = of_document(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), keys, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    runs = cut(texts.select("doc_id", "text_hash", *[matches(pieces(F.col("text"), p, F.lit(True))).alias(k) for k, p in BARE.items()]).withColumn("uid", F.monotonically_increasing_id()), "secret-runs")
    found = located(runs, list(BARE), "doc_id", "text_hash").select("doc_id", "text_hash", "start", "end", *hashes(F.col("value")))
    return of_document(found, hits, "left_semi", *KEY).select("doc_id", "text_hash", "start", "end").distinct()


def find(docs: DataFrame) -> DataFrame:
    """uid, doc_id, base and more (place, start, end, kind, live) of each document, in order."""
    scan = scanned(docs)
    rows = located(scan, KINDS, "text_hash", "owner").filter(valid(F.col("kind"), F.col("value")))
    base = cut(rows.select("uid", "text_hash", "owner", "place", "kind", "start", "end", *hashes(secret(F.col("kind"), F.col("value")))), "secret-base")
    seen = cut(bare(docs, cut(base.select(KEY).distinct(), "secret-candidates")), "secret-bare")
    owned = cut(ownership(base, seen), "secret-owners")
    live = cut(owned.filter("live").select(KEY), "secret-live")
    hits = cut(joined(seen, live, KEY, "left_semi").select("doc_id", "text_hash", *KEY).distinct(), "secret-hits")
    reused = cut(occurrences(docs, hits), "secret-reused")
    more = of_document(scan.select("uid", "doc_id", "text_hash"), reused, "inner").select("uid", F.lit(len(KINDS)).alias("place"), F.lit("reuse").alias("kind"), "start", "end", F.lit(True).alias("live"))
    known = joined(base, owned.select(*KEY, "live"), KEY)
    columns = ["uid", "place", "kind", "start", "end", "live"]
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("place").cast("int").alias("place"), F.col("end").cast("long").alias("end"), "kind", "live")
    by_doc = apart(known.select(columns).unionByName(more), len(KINDS)).groupBy("uid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    parts = by_doc.select("uid", F.filter("spans", lambda s: s["place"] < len(KINDS)).alias("base"), F.filter("spans", lambda s: s["place"] == len(KINDS)).alias("more"))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string,live:boolean>>")
    return scan.select("uid", "doc_id").join(parts, "uid", "left").select("uid", "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("more", none).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    of_kind = lambda kind: count(lambda s: s["kind"] == kind)
    count = lambda test: F.size(F.filter("base", test)).cast("long")
    return found.select("doc_id", *[of_kind(k).alias(f"n_{k}") for k in KINDS], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.array_sort(F.concat("base", "more"))).alias("spans"), count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"))
