"""Chunks of Markdown tables: segments, a header repeated over each part, whole rows, and rows too long cut apart.

A part depends on what the parts before it took, so a block is folded in Python; each block is one row, and blocks
need nothing from one another: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

# The headers of tables that have none of their own, of flattened ones and of empty ones, the marks of
# quality, and the names of what a part shares with the one before.
BARE, FLAT, FALLBACK, EMPTY = "|  |\n| --- |", "| 표 내용 |\n| --- |", "| 내용 |\n| --- |", "(내용 없음)"
ROW_SPLIT, HEADER_SPLIT, HEADER_EXHAUSTED, FLATTENED = "oversized_table_row_split", "oversized_table_header_split", "table_header_budget_exhausted_fallback", "table_structure_flattened_fallback"
NONE, HEADER, ROWS_AND_HEADER = "none", "header_repeat_only", "whole_row_plus_header_repeat"
BREAKS = ("\n\n", "\n", " ")

SEPARATOR = re.compile(r"\|(?:\s*:?-{3,}:?\s*\|)+")
SCHEMA = "segment_no long, segment_count long, part_no long, part_count long, block_part_no long, text string, size long, row_start long, row_end long, header_repeated boolean, overlap_mode string, overlap long, flags array<string>"


@dataclass(frozen=True)
class Segment:
    """A header of context lines, column names and separator, the rows under it, and all of it as plain lines."""

    header: str
    rows: tuple[str, ...]
    plain: tuple[str, ...]


@dataclass(frozen=True)
class Part:
    text: str
    row_start: int | None = None
    row_end: int | None = None
    repeated: bool = False
    mode: str = NONE
    overlap: int = 0
    flags: tuple[str, ...] = ()


def cell(value: str) -> str:
    return value.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " / ")


def is_row(line: str) -> bool:
    return len(line) >= 2 and line[0] == line[-1] == "|"


def parse(markdown: str | None) -> list[Segment]:
    """The tables of a block with the lines ahead of each as its context. Rows without a separator below the first,
    and lines after the last table, become tables of one column. Null and blank blocks have none."""
    lines = [line.strip() for line in (markdown or "").splitlines()]
    out: list[Segment] = []
    context: list[str] = []
    for table, run in groupby(lines, is_row):
        group = list(run)
        if not table:
            context += [line for line in group if line]
            continue
        headed = len(group) > 1 and SEPARATOR.fullmatch(group[1]) is not None
        header, rows = ("\n".join(group[:2]), group[2:]) if headed else (BARE, [f"| {cell(row)} |" for row in group])
        name = [group[0][1:-1].strip()] if headed else [""]
        out.append(Segment("\n".join([*context, header]), tuple(rows), (*context, *name, *rows)))
        context = []
    if context:
        rows = tuple(f"| {cell(line)} |" for line in context)
        out.append(Segment(BARE, rows, rows))
    return out


def fallback(text: str | None) -> str:
    """A table of one column from the lines of a block that holds no table."""
    lines = [line.strip() for line in (text or "").splitlines() if line.strip()] or [EMPTY]
    return "\n".join([FALLBACK, *(f"| {cell(line)} |" for line in lines)])


def pieces(text: str, fits: Callable[[str], bool]) -> list[str]:
    """Consecutive pieces that fit, cut behind a paragraph, line or blank if there is one, else between characters.
    Empty if not even one character fits."""
    out, at = [], 0
    while at < len(text):
        low, high, step = 0, 0, 64
        while low == high and high < len(text) - at:  # reach out from the piece's start, not over the whole text
            high = min(len(text) - at, high + step)
            low, step = (high, 2 * step) if fits(text[at : at + high]) else (low, step)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if fits(text[at : at + middle]) else (low, middle - 1)
        if not low:
            return []
        if at + low < len(text):
            found = ((text.rfind(b, at, at + low), len(b)) for b in BREAKS)
            low = next((place + n - at for place, n in found if place >= 0), low)
        out.append(text[at : at + low])
        at += low
    return out


def parts(segment: Segment, limit: int, overlap: int = 0, prefix: str | None = None, count: Callable[[str], int] = len) -> list[Part]:
    """Parts of at most `limit` tokens, context prefix and header included. Whole rows of the part before are
    repeated up to `overlap` tokens, as far as the next row still fits. A row over the limit is cut into pieces
    below the header; where the header leaves no room, the whole segment is flattened into one column."""
    ahead = f"{prefix}\n\n" if prefix else ""
    fits = lambda text: count(ahead + text) <= limit
    below = lambda lines: "\n".join([segment.header, *lines])
    if not fits(segment.header):
        return flattened(segment, fits, HEADER_SPLIT)
    units: list[tuple[int, str, bool]] = []
    for number, row in enumerate(segment.rows, 1):
        whole = fits(below([row]))
        fragments = [row] if whole else pieces(row, lambda text: fits(below([text])))
        if not fragments:
            return flattened(segment, fits, HEADER_EXHAUSTED)
        units += [(number, text, not whole) for text in fragments]
    flags = (ROW_SPLIT,) if any(split for _, _, split in units) else ()
    if not units:
        return [Part(segment.header)]
    out: list[Part] = []
    at, fresh = 0, 0  # the part's new units are units[at:end], those of the part before units[fresh:at]
    while at < len(units):
        shared = at
        while out and shared > fresh and overlap > 0 and count("\n".join(u[1] for u in units[shared - 1 : at])) <= overlap:
            shared -= 1
        while shared < at and not fits(below([u[1] for u in units[shared : at + 1]])):
            shared += 1
        end = at + 1
        while end < len(units) and fits(below([u[1] for u in units[shared : end + 1]])):
            end += 1
        present = units[shared:end]
        mode = NONE if not out else ROWS_AND_HEADER if shared < at else HEADER
        again = count("\n".join(u[1] for u in units[shared:at])) if shared < at else 0
        out.append(Part(below([u[1] for u in present]), present[0][0], present[-1][0], bool(out), mode, again, flags))
        fresh, at = at, end
    return out


def flattened(segment: Segment, fits: Callable[[str], bool], flag: str) -> list[Part]:
    """The segment's lines as cells of one column. Raises if its own header leaves no room for a character."""
    wrap = lambda text: f"{FLAT}\n| {text} |"
    source = cell("\n".join(line for line in segment.plain if line))
    texts = pieces(source, lambda text: fits(wrap(text)))
    if source and not texts:
        raise ValueError("the limit leaves no room for a table's text beside its prefix")
    first = Part(wrap(""), flags=(flag, FLATTENED))
    return [replace(first, text=wrap(t), repeated=i > 0, mode=HEADER if i else NONE) for i, t in enumerate(texts)]


def chunked(blocks: DataFrame, limit: int = 512, overlap: int = 51, count: Callable[[str], int] = len) -> DataFrame:
    """blocks: key, prefix, markdown, one row each. key and the columns of SCHEMA, one row for each part. `size`
    counts prefix and text. A block without a table, null and empty ones too, becomes a table of one column."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prefix, markdown in frame.itertuples(index=False):
                number, segments = 0, parse(markdown) or parse(fallback(markdown))
                for i, segment in enumerate(segments, 1):
                    cut = parts(segment, limit, overlap, prefix, count)
                    for j, p in enumerate(cut, 1):
                        number += 1
                        size = count(f"{prefix}\n\n{p.text}" if prefix else p.text)
                        rows.append((key, i, len(segments), j, len(cut), number, p.text, size, p.row_start, p.row_end, p.repeated, p.mode, p.overlap, list(p.flags)))
            out = pd.DataFrame(rows, columns=["key", *(c.split()[0] for c in SCHEMA.split(", "))])
            yield out.astype({"row_start": "Int64", "row_end": "Int64"})

    kind = blocks.schema["key"].dataType.simpleString()
    return blocks.select("key", "prefix", "markdown").mapInPandas(fold, f"key {kind}, {SCHEMA}")
