"""Chunks of long texts by paragraphs and sentences, as one native fold over a text's paragraphs.

The fold keeps the finished chunks and a buffer. A paragraph that does not fit flushes the
buffer and starts the next one as it is, however long; only when it meets an empty buffer is
it folded sentence by sentence, and a sentence that does not fit an empty buffer keeps its
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.strings import strip

TRUNCATED = "\n\n[TEXT TRUNCATED - DOCUMENT CONTINUES]"


def _state(done: Column, cur: Column) -> Column:
    return F.struct(done.alias("done"), cur.alias("cur"))


def _fits(cur: Column, piece: Column, limit: Column) -> Column:
    return F.length(cur) + F.length(piece) + 2 <= limit


def _by_sentence(acc: Column, paragraph: Column, limit: Column) -> Column:
    def step(a: Column, s: Column) -> Column:
        flushed = _state(F.array_append(a["done"], strip(a["cur"])), s)
        cut = _state(F.array_append(a["done"], F.left(s, limit)), F.lit(""))
        return F.when(_fits(a["cur"], s, limit), _state(a["done"], F.concat(a["cur"], s, F.lit(". ")))).when(a["cur"] != "", flushed).otherwise(cut)

    return F.aggregate(F.split(paragraph, r"\. ", -1), acc, step)


def chunks(text: Column, max_chars: Column) -> Column:
    """The chunks of a text; a text within the limit is one chunk, unchanged."""
    limit = max_chars.cast("int")

    def step(a: Column, p: Column) -> Column:
        fits = _state(a["done"], F.concat(a["cur"], p, F.lit("\n\n")))
        flushed = _state(F.array_append(a["done"], strip(a["cur"])), p)
        return F.when(_fits(a["cur"], p, limit), fits).when(a["cur"] != "", flushed).otherwise(_by_sentence(a, p, limit))

    def finish(a: Column) -> Column:
        rest = strip(a["cur"])
        return F.when(rest != "", F.array_append(a["done"], rest)).otherwise(a["done"])

    start = _state(F.array().cast("array<string>"), F.lit(""))
    folded = F.aggregate(F.split(text, "\n\n", -1), start, step, finish)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(folded)


def chunk_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_col: str = "max_chars") -> DataFrame:
    """``id, chunk_no, n_chunks, chunk``; chunks are numbered from 1."""
    made = documents.select(id_col, chunks(F.col(text_col), F.col(limit_col)).alias("chunks_"))
    return made.select(id_col, F.size("chunks_").alias("n_chunks"), F.posexplode("chunks_").alias("pos", "chunk")).select(id_col, (F.col("pos") + 1).alias("chunk_no"), "n_chunks", "chunk")


def truncated(text: Column, max_chars: Column) -> Column:
    """A text that gives a single chunk though it is too long: its first characters and a mark."""
    return F.when((F.length(text) > max_chars) & (F.size(chunks(text, max_chars)) <= 1), F.concat(F.left(text, max_chars), F.lit(TRUNCATED)))


def prompts(rows: DataFrame, prompt: str) -> DataFrame:
    """Adds ``prompt`` to chunk rows, which says which part of how many follows."""
    part = F.format_string("\n\nThis is part %d of %d of the document.\n\nDocument content:\n", F.col("chunk_no"), F.col("n_chunks"))
    whole = F.lit("\n\nDocument content:\n")
    return rows.withColumn("prompt", F.concat(F.lit(prompt), F.when(F.col("n_chunks") > 1, part).otherwise(whole), F.col("chunk")))
