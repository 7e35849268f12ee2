"""Splitting oversized items at natural boundaries (problem 1).

A text is parsed into a tree: numbered paragraphs, list items, lines, sentences, words. Only
nodes above the limit are descended into; whole siblings are merged from the bottom up as long as
they fit, never with a part of an oversized one. Every piece but the first begins with an overlap: the end of the piece before, from a word
start at most so many characters back.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150

# What begins or ends a node, from the widest to the narrowest.
LEVELS = [
    re.compile(r"^(?=(?:(?:GEÇİCİ|Geçici|EK|Ek)[ \t]+)?(?:MADDE|Madde)[ \t]+\d|\([IVX]+\) SAYILI|#+ )", re.M),
    re.compile(r"\n[ \t]*\n+|^(?=\(\d+\))", re.M),
    re.compile(r"^(?=[a-zçğıöşü]{1,2}\)[ \t])", re.M),
    re.compile(r"\n"),
    re.compile(r"(?<!\bm\.)(?<!\bs\.)(?<!\bNo\.)(?<!\bvb\.)(?<=[.!?…])[\"”’)\]]*\s+(?=[^\W\da-zçğıöşü_]|[\"“(\d])"),
    re.compile(r"(?<=[;,:])\s+"),
    re.compile(r"\s+"),
]
MARK = re.compile(r"[\u0300-\u036f\u200d\ufe0f]")


def nodes(text: str, start: int, end: int, level: int) -> list[tuple[int, int]]:
    """The children of text[start:end] at a level; a separator stays with what it ends."""
    cuts = [start]
    for m in LEVELS[level].finditer(text, start, end):
        if cuts[-1] < m.end() < end:
            cuts.append(m.end())
    return list(zip(cuts, [*cuts[1:], end]))


def word_parts(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """Spans of a word above the limit: as long as they may be, but not before a mark."""
    spans = []
    while end - start > limit:
        at = start + limit
        while at > start + limit // 2 and MARK.match(text, at):
            at -= 1
        spans.append((start, at))
        start = at
    return [*spans, (start, end)]


def pack(text: str, start: int, end: int, limit: int, level: int = 0) -> list[tuple[int, int]]:
    """Spans of at most limit characters that cover text[start:end]."""
    if end - start <= limit:
        return [(start, end)]
    if level == len(LEVELS):
        return word_parts(text, start, end, limit)
    spans: list[tuple[int, int]] = []
    whole = False  # whether the last span is made of whole siblings
    for a, b in nodes(text, start, end, level):
        if b - a > limit:
            spans += pack(text, a, b, limit, level + 1)
            whole = False
        elif whole and b - spans[-1][0] <= limit:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
            whole = True
    return spans


def overlap_start(text: str, at: int, first: int, overlap: int) -> int:
    """Where the overlap before at begins: the first word start at most overlap back."""
    low = max(first, at - overlap)
    if low == first or text[low - 1].isspace():
        return low
    space = re.compile(r"\s+").search(text, low, at)
    return space.end() if space and space.end() < at else low


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, begin of new text, end) of each piece; the spans of new text cover the text."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out: list[tuple[int, int, int]] = []
    for a, b in pack(text, 0, len(text), limit - overlap):
        out.append((overlap_start(text, a, out[-1][1], overlap) if out else 0, a, b))
    return out


def piece_spans(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of (start, new, end) offsets in code points. A text within the limit, the empty one
    too, is one piece and never leaves the JVM; null gives null."""
    kind = "array<struct<start:int,new:int,end:int>>"
    fields = pa.struct([("start", pa.int32()), ("new", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        rows = [None if t is None else [dict(zip(("start", "new", "end"), p)) for p in pieces_of(t, limit, overlap)] for t in column.to_pylist()]
        return pa.array(rows, pa.list_(fields))

    # not deterministic to the planner, lest a filter on the result computes the pieces a second time
    run = run.asNondeterministic()
    zero = F.lit(0)
    one = F.array(F.struct(zero.alias("start"), zero.alias("new"), F.length(text).alias("end"))).cast(kind)
    return F.when(F.length(text) <= limit, one).otherwise(run(F.when(F.length(text) > limit, text)))


def split_items(items: DataFrame, keys: list[str], text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(keys, piece, start, new, end, text) with a row per piece: text is start..end, of which
    start..new repeats the piece before. Null items give no row, empty ones one empty piece;
    rows with the same keys are split each on its own. keys may not be named like the result."""
    texts = items.select(*keys, F.col(text_col).alias("_text")).where("_text is not null")
    out = texts.select(*keys, "_text", piece_spans(F.col("_text"), limit, overlap).alias("_spans")).select(*keys, "_text", F.posexplode("_spans").alias("piece", "_p"))
    columns = [*keys, "piece", F.col("_p.start").alias("start"), F.col("_p.new").alias("new"), F.col("_p.end").alias("end")]
    if with_text:
        columns.append(F.expr("substring(_text, _p.start + 1, _p.end - _p.start)").alias("text"))
    return out.select(*columns)
