"""One record for each document from the records of its chunks.

One exchange on the document: scalars by ``min_by`` (partial aggregates before the exchange),
ordered texts and arrays by a collected list of the document's own chunks, sorted there.

Defined results
    error records count as chunks and give nothing else; a document with only errors has empty
    values; null fields are skipped; repeated rows are merged as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = ("detailed_sections", "rules_and_provisions", "penalties_and_consequences", "action_items", "definitions")
ENTITIES = ("people", "organizations", "locations", "amounts", "dates", "references")


def _first(x: Column, use: Column, order: Column) -> Column:
    return F.min_by(F.when(use, x), F.when(use, order))


def _in_order(x: Column, order: str) -> Column:
    """The values of a group that are not null, by chunk."""
    kept = F.collect_list(F.when(x.isNotNull(), F.struct(F.col(order).alias("o"), x.alias("v"))))
    return F.transform(F.sort_array(kept), lambda e: e["v"])


def _text(x: Column, order: str, before: str) -> Column:
    """Texts in order, each behind ``before``; empty texts are skipped."""
    values = _in_order(F.when(x != "", x), order)
    return F.aggregate(values, F.lit(""), lambda a, v: F.concat(a, F.lit(before), v))


def _joined(x: Column, order: str) -> Column:
    return F.flatten(_in_order(F.when(F.size(x) > 0, x), order))


def _some(info: Column) -> Column:
    """Whether a struct has a field that is not null."""
    return info.isNotNull() & (F.to_json(info) != "{}")


def merge_chunks(typed: DataFrame, key: str = "doc_id", order: str = "chunk_no", more: tuple[Column, ...] = ()) -> DataFrame:
    """The merged record of each document; lists of entities are sorted, key points keep their order.

    ``more`` are further aggregates of the same exchange.
    """
    r = F.col("record")
    main = r["main_content"]
    pos = F.col(order)
    return typed.groupBy(key).agg(
        _first(r["document_info"], _some(r["document_info"]), pos).alias("document_info"),
        F.struct(
            F.coalesce(_first(main["purpose"], main["purpose"] != "", pos), F.lit("")).alias("purpose"),
            _text(main["summary"], order, " ").alias("summary"),
            F.array_distinct(_joined(main["key_points"], order)).alias("key_points"),
        ).alias("main_content"),
        *[_joined(r[x], order).alias(x) for x in LISTS],
        F.struct(*[F.sort_array(F.array_distinct(_joined(r["important_entities"][x], order))).alias(x) for x in ENTITIES]).alias("important_entities"),
        _text(r["full_text_content"], order, "\n\n").alias("full_text_content"),
        F.lit("multi_chunk").alias("processing_method"),
        F.count("*").cast("int").alias("total_chunks"),
        *more,
    )


def pages_to_text(pages: DataFrame, key: str, order: str, text_col: str) -> DataFrame:
    """The text of a document: its pages in order, a line end behind each, stripped."""
    from quillspark.functions.strings import strip

    lines = F.aggregate(_in_order(F.col(text_col), order), F.lit(""), lambda a, v: F.concat(a, v, F.lit("\n")))
    return pages.groupBy(key).agg(strip(lines).alias("text"))
