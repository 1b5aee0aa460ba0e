"""Text normalisation and string functions as Column expressions; nothing here leaves the JVM but nfc()."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line separators, leader characters, table and unsafe tags, top-level heading form, size limits.
LINE_SEPARATORS = "\n\r\x0b\x0c\x85  "
LEADERS = "[·․‧∙⋅]{5,}|\\.{5,}"
TAGS = "table|thead|tbody|caption|tr|th|td|img|p|li|br|script|style|iframe"
HEADING = r"^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|제\s*\p{Nd}+\s*장)\s*[.)]?\s*.+$"
HEADING_CHARS, HEADING_LINES, NGRAM, LEXICAL_SPLIT = 200, 3, 5, r"[^\p{L}\p{N}_-]+"
NON_CONTENT = "[^0-9A-Za-z가-힣]"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, for which Spark has no expression."""
    return text.str.normalize("NFC")


def collapse_leader_dots(x: Column) -> Column:
    """Five or more leader characters in a row become one blank."""
    return F.regexp_replace(x, LEADERS, " ")


def normalize_text(x: Column) -> Column:
    """Line ends unified, leaders collapsed, lines stripped at the right, runs of blank lines reduced to one and
    outer ones removed; the first indent stays. Null becomes empty. Doing it twice changes nothing more."""
    unified = collapse_leader_dots(F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n"))
    stripped = F.regexp_replace(unified, r"(?m)[\s&&[^\n]]+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def compact_text(x: Column) -> Column:
    """normalize_text with each run of white space as one blank."""
    return F.trim(F.regexp_replace(normalize_text(x), r"\s+", " "))


def embedding_text(x: Column) -> Column:
    """Each line separator becomes a blank, so that positions stay."""
    return F.translate(x, LINE_SEPARATORS, " " * len(LINE_SEPARATORS))


def alnum_count(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")).cast("long")


def neutralize_tags(x: Column) -> Column:
    """Angle brackets of table and unsafe tags are escaped; all other text stays."""
    closed = F.regexp_replace(x, rf"(?i)<(/?(?:{TAGS})\b[^<>]*)>", "&lt;$1&gt;")
    return F.regexp_replace(closed, rf"(?i)<(/?(?:{TAGS})\b)", "&lt;$1")


def escape_cell(x: Column) -> Column:
    """A Markdown table cell: normalised, newline runs become ' / ', backslash and pipe are escaped, tags neutralised."""
    lines = F.regexp_replace(normalize_text(x), "\n+", " / ")
    return neutralize_tags(F.replace(F.replace(lines, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))


def escape_html(x: Column) -> Column:
    out = F.coalesce(x, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def heading_of(x: Column) -> Column:
    """The first of the first three lines that looks like a top-level heading; null without one."""
    lines = F.transform(F.slice(F.split(normalize_text(x), "\n"), 1, HEADING_LINES), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.get(F.filter(lines, lambda s: (F.length(s) <= HEADING_CHARS) & F.rlike(s, F.lit(HEADING))), F.lit(0))


def page_marker_key(x: Column) -> Column:
    """Dashes of any kind as '-', format characters gone, private-use characters and blanks as one blank."""
    dashed = F.regexp_replace(F.regexp_replace(x, r"[\p{Pd}−]", "-"), r"\p{Cf}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(dashed, r"[\p{Co}\s]", " "), " +", " "))


def page_marker(x: Column) -> Column:
    """The page numbers of a text that holds nothing but `- n -` markers of consecutive pages, else null.
    Numbers run from 1 to 999 without leading zeros."""
    key = page_marker_key(x)
    numbers = F.transform(F.regexp_extract_all(key, F.lit("- ?([1-9][0-9]{0,2}) ?-"), F.lit(1)), lambda s: s.cast("int"))
    whole = F.rlike(key, F.lit("^- ?[1-9][0-9]{0,2} ?-(?: ?- ?[1-9][0-9]{0,2} ?-)*$"))
    rising = F.forall(F.transform(numbers, lambda n, i: n - i), lambda d: d == F.element_at(numbers, 1))
    return F.when(whole & (F.size(numbers) > 0), F.when(rising, numbers))


def lexical_tokens(x: Column) -> Column:
    """Lower-case words of letters, numbers, '_' and '-': the default tokenizer of both index and queries."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), LEXICAL_SPLIT), lambda t: t != "")


def ngrams(x: Column, n: int = NGRAM) -> Column:
    """Distinct character n-grams of a text's digits, Latin and Hangul letters; empty below n characters."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), NON_CONTENT, "")
    # a look-ahead matches at each place, in one pass; substrings by place would each count from the start
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def sentences(x: Column) -> Column:
    """The default splitter: after . ! or ? before white space. Joined again, sentences give the text."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), r"([.!?])(\s+)", "$1\u0001$2"), "\u0001"), lambda s: s != "")


def truncated(x: Column, n: int = 300) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def split_ids(x: Column, separator: str = "|") -> Column:
    """Trimmed, non-empty parts; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), f"\\Q{separator}\\E"), lambda s: F.trim(s)), lambda s: s != "")


def plain_table(x: Column) -> Column:
    """A Markdown table's cell values, blank-separated, one line per row; separators and image references go."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", " "), "\n"), lambda s: F.trim(s)), lambda s: s != "")

    def row(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda s: F.trim(s))
        return F.when(~F.startswith(line, F.lit("|")), line).otherwise(F.array_join(F.filter(cells, lambda c: ~F.rlike(c, F.lit("^[-: ]*$"))), " "))

    return F.trim(F.array_join(F.filter(F.transform(lines, row), lambda s: ~F.rlike(s, F.lit("^[-: ]*$"))), " "))


def strategy_id(size: int, overlap: int, prefix: str = "naive_fixed") -> str:
    """The name of a chunking configuration; an overlap must leave room for new content."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    return f"{prefix}_{size}_{overlap}"


def default_overlap(size: int) -> int:
    """A tenth, halves to even."""
    return round(size / 10)


def json_text(x: Column) -> Column:
    """The JSON text of an answer without its code fence: the whole if it begins and ends as an object or an array,
    else the longer one that parses of the stretches between its outermost braces and brackets; null if none does."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    whole = F.rlike(bare, F.lit(r"(?s)^(?:\{.*\}|\[.*\])$"))
    braces, brackets = F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    # the parser stops after the first value, so that what follows it shows only within an array and an object
    within = lambda a, c, b: F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))).isNotNull()
    parses = lambda c: F.when((c != "") & within("[", c, "]") & within('{"v":', c, "}"), c)
    longer = F.when(F.length(brackets) > F.length(braces), F.coalesce(parses(brackets), parses(braces))).otherwise(F.coalesce(parses(braces), parses(brackets)))
    return F.when(whole, bare).otherwise(longer)


def json_in(x: Column, schema: str) -> Column:
    """The JSON object or array of an answer, by schema; null where there is none."""
    return F.from_json(json_text(x), schema)
