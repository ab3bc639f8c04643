"""Pieces of oversized texts, cut at natural boundaries, by structure-tree packing.

A text is a tree: headings by rank (parts, chapters, sections, as words, marks or markup), list
items, paragraphs, lines, sentences, words, characters. A node within the limit is kept whole; neighbouring siblings
are merged while they fit; only an oversized node is opened, and what is packed in it is not
merged with its parent's other children, so a piece ends at the highest boundary that the limit
allows and never joins the end of one section to the start of the next unless both stand in it
whole. Each piece but the first starts early enough to repeat at least ``overlap`` characters
of the one before it, at a sentence or word start near that place, and never exceeds the limit.

Defined results
    null, empty and fitting texts give one piece (``oversized`` leaves them out); a text of
    exactly the limit fits; text without any boundary is cut at the limit; pieces without their
    overlap join to the text; limits must leave room for the overlap (``2 * overlap < limit``);
    repeated rows give their pieces again; empty tables give empty results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._arrow import map_blocks

#: Where the nodes of each level start; headings and list items are at the start of a line, higher ranks first.
_HEADINGS = tuple(
    re.compile(rf"(?im)^[ \t]*(?:{x})")
    for x in (
        r"#\s|<h1\b|(?:part|schedule|annex\w*|appendix)\s+[\w-]+\b",
        r"##\s|<h2\b|chapter\s+[\w-]+\b|[IVXLC]{1,7}\.\s",
        r"###\s|<h3\b|(?:section|article|rule|§)\s*\d|\d{1,4}\.\s|[^\W\d]+ \d{1,4}\.\s",
        r"#{4,6}\s|<h[4-6]\b|<li\b|\(?\d{1,3}\)\s|\d{1,3}\.\d{1,3}\.?\s|\([a-z]{1,4}\)\s|[-*•]\s",
    )
)
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*|<p\b")
_LINE = re.compile(r"\n+|<br\b")
_SENTENCE = re.compile(r"[.।!?;][\"'”’)\]}]*\s+")
_WORD = re.compile(r"\s+")
_LEVELS = (*_HEADINGS, _PARAGRAPH, _LINE, _SENTENCE, _WORD)


def _children(text: str, a: int, b: int, level: re.Pattern) -> list[tuple[int, int]]:
    """The node's children at a level; they join to it."""
    starts = [a]
    for m in level.finditer(text, a, b):
        # headings and markup begin the next node, white space ends the one before
        at = m.start() if level in _HEADINGS or text[m.start()] == "<" else m.end()
        if starts[-1] < at < b and text[a:at].strip():
            starts.append(at)
    return list(zip(starts, [*starts[1:], b]))


def pack(text: str, limit: int) -> list[tuple[int, int]]:
    """Neighbouring spans of at most ``limit`` characters that join to the text."""

    def down(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if b - a <= limit:
            return [(a, b)]
        while level < len(_LEVELS):
            parts = _children(text, a, b, _LEVELS[level])
            level += 1
            if len(parts) > 1:
                out: list[tuple[int, int]] = []
                whole = False  # whether the last piece is of whole siblings
                for x, y in parts:
                    if y - x > limit:
                        out += down(x, y, level)
                        whole = False
                    elif whole and y - out[-1][0] <= limit:
                        out[-1] = (out[-1][0], y)
                    else:
                        out.append((x, y))
                        whole = True
                return out
        return [(k, min(k + limit, b)) for k in range(a, b, limit)]

    return down(0, len(text), 0)


def _early(text: str, floor: int, at: int) -> int:
    """The latest sentence or else word start in ``[floor, at]``, else ``at``."""
    for pattern in (_SENTENCE, _WORD):
        found = [m.end() for m in pattern.finditer(text, max(floor - 1, 0), at + 1) if floor <= m.end() <= at]
        if found:
            return found[-1]
    return at


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Overlapping spans of at most ``limit`` characters that cover the text in order."""
    if len(text) <= limit:
        return [(0, len(text))]
    if overlap and 2 * overlap >= limit:
        raise ValueError("the overlap leaves no room for new text")
    slack = min(overlap, (limit - 2 * overlap) // 2) if overlap else 0
    core = pack(text, limit - overlap - slack)
    out = [core[0]]
    for a, b in core[1:]:
        start = _early(text, max(a - overlap - slack, out[-1][0] + 1, 0), max(a - overlap, out[-1][0] + 1)) if overlap else a
        out.append((start, b))
    return out


_PIECES = pa.schema([("id", pa.int64()), ("field", pa.string()), ("pos", pa.int32()), ("piece_no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("piece", pa.string())])


def oversized(values: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Pieces of the values longer than their field's limit.

    ``values`` has ``id, field, pos, text``; ``limits`` gives a field's ``max_chars`` and
    ``overlap_chars``. Fitting values are dropped before any text leaves the scan.
    """
    too_long = F.lit(False)
    for field, (most, _) in limits.items():
        too_long = too_long | ((F.col("field") == field) & (F.length("text") > most))

    def kernel(ids: list, fields: list, positions: list, texts: list) -> list:
        out = []
        for i, f, p, t in zip(ids, fields, positions, texts):
            out += [(i, f, p, k, a, b, t[a:b]) for k, (a, b) in enumerate(pieces(t, *limits[f]))]
        return [list(x) for x in zip(*out)] if out else [[] for _ in _PIECES]

    own = values.select(F.col("id").cast("bigint").alias("id"), "field", F.col("pos").cast("int").alias("pos"), F.col("text").cast("string").alias("text"))
    return map_blocks(own.filter(too_long), "text", kernel, "id bigint, field string, pos int, piece_no int, start int, stop int, piece string", _PIECES)


def record_values(records: DataFrame) -> DataFrame:
    """``id, field, pos, text``: the full text and the content of each section of each record."""
    full = records.select(F.col("rec_id").alias("id"), F.lit("full_text_content").alias("field"), F.lit(0).alias("pos"), F.col("full_text_content").alias("text"))
    sections = records.select(F.col("rec_id").alias("id"), F.posexplode(F.col("detailed_sections.content")).alias("pos", "text"))
    return full.unionByName(sections.select("id", F.lit("detailed_sections").alias("field"), "pos", "text"))
