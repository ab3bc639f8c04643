"""Records from model replies: fences off, strict parse, repair, fallback.

What counts as JSON is what the Python standard library accepts (no native function accepts
exactly that), so replies are parsed in Arrow batches; the result is a struct of status and
canonical JSON text, from which ``typed`` makes the nested record natively.

Defined results
    a null reply gives a null struct; an empty one has no structure and falls back; a top level
    that is no object is an error (``not_object``); keys that occur twice keep the last value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.strings import strip

PARSED, REPAIRED, FALLBACK, NOT_OBJECT = "parsed", "repaired", "fallback", "not_object"
NO_STRUCTURE, PARSE_FAILED = "No JSON structure found", "JSON parsing failed"

#: The extraction record.
RECORD = """
document_info STRUCT<title:STRING,type:STRING,reference_number:STRING,date:STRING,authority:STRING>,
main_content STRUCT<purpose:STRING,summary:STRING,key_points:ARRAY<STRING>>,
detailed_sections ARRAY<STRUCT<section_title:STRING,content:STRING,key_details:ARRAY<STRING>>>,
rules_and_provisions ARRAY<STRUCT<rule:STRING,details:STRING,applies_to:STRING>>,
penalties_and_consequences ARRAY<STRUCT<violation:STRING,penalty:STRING,amount:STRING,conditions:STRING>>,
important_entities STRUCT<people:ARRAY<STRING>,organizations:ARRAY<STRING>,locations:ARRAY<STRING>,amounts:ARRAY<STRING>,dates:ARRAY<STRING>,references:ARRAY<STRING>>,
action_items ARRAY<STRING>,
definitions ARRAY<STRUCT<term:STRING,definition:STRING>>,
full_text_content STRING
"""

#: The marks of a fallback record.
FALLBACK_TITLE = "Raw Content - JSON Parse Failed"
REPAIR_NOTE = "JSON was automatically repaired"
FALLBACK_PURPOSE = "Content extraction encountered JSON parsing issues"

#: Rewrites of the light and of the thorough repair, in order.
CONTROL = r"[\x00-\x1f\x7f-\x9f]"
LIGHT = ((CONTROL, ""), (r",(\s*[}\]])", r"\1"), (r'(?<!\\)"(?=.*".*:)', '\\"'))
THOROUGH = ((CONTROL, ""), (r'\\"', '"'), (r"\\\\", r"\\"), (r",\s*}", "}"), (r",\s*]", "]"), (r"(\w+):", r'"\1":'), (r"'([^']*)'", r'"\1"'))


def strip_fences(reply: Column) -> Column:
    """A reply without its code fence and outer white space."""
    bare = strip(reply)
    opened = strip(F.regexp_replace(bare, r"\A```(?:json)?", ""))
    return F.when(bare.startswith("```"), strip(F.regexp_replace(opened, r"```\z", ""))).otherwise(strip(F.regexp_replace(bare, r"```\z", "")))


def balanced(text: str) -> str | None:
    """From the first ``{`` to the ``}`` after which as many are closed as opened since the text's start."""
    depth, first = 0, None
    for m in re.finditer("[{}]", text):
        if m.group() == "{":
            depth += 1
            first = m.start() if first is None else first
        else:
            depth -= 1
            if depth == 0 and first is not None:
                return text[first : m.end()]
    return None


def _rewritten(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in rules:
        text = re.sub(pattern, to, text)
    return text


def _loads(text: str) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def parse(bare: str) -> tuple[str, str | None, str | None]:
    """``status, json, note`` of a reply without fences."""
    attempts = [(PARSED, lambda: bare)]
    piece = balanced(bare)
    if piece is not None:
        attempts += [(PARSED, lambda: _rewritten(piece, LIGHT)), (REPAIRED, lambda: _rewritten(piece, THOROUGH))]
    for status, text in attempts:
        ok, value = _loads(text())
        if ok:
            return (status, json.dumps(value, ensure_ascii=False), None) if isinstance(value, dict) else (NOT_OBJECT, None, "the top level is no object")
    return FALLBACK, None, NO_STRUCTURE if piece is None else PARSE_FAILED


@F.pandas_udf(T.StructType([T.StructField(x, T.StringType()) for x in ("status", "json", "note")]))
def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for replies in batches:
        yield pd.DataFrame([(None, None, None) if r is None else parse(r) for r in replies], columns=["status", "json", "note"])


def parse_replies(replies: DataFrame, text_col: str = "response_text", method_col: str = "method") -> DataFrame:
    """Adds ``status, json, note`` and ``method_resolved``, the method marked by how the reply was read."""
    parsed = replies.withColumn("bare_", strip_fences(F.col(text_col))).withColumn("p_", _parse("bare_")).drop("bare_")
    suffix = F.when(F.col("p_.status") == REPAIRED, "_repaired").when(F.col("p_.status") == FALLBACK, "_fallback").otherwise("")
    return parsed.select("*", "p_.status", "p_.json", "p_.note", F.concat(F.col(method_col), suffix).alias("method_resolved")).drop("p_")


STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(at: Column | None = None) -> Column:
    """A time as text; the present one by default."""
    return F.date_format(F.current_timestamp() if at is None else at, STAMP)


def metadata(at: Column | None = None) -> Column:
    """``processing_method, processed_timestamp, note`` of a parsed reply; null where the reply is no object.

    The note says that a reply was repaired, or why it fell back.
    """
    note = F.when(F.col("status") == REPAIRED, F.lit(REPAIR_NOTE)).when(F.col("status") == FALLBACK, F.col("note"))
    made = F.struct(F.col("method_resolved").alias("processing_method"), stamp(at).alias("processed_timestamp"), note.alias("note"))
    return F.when(F.col("status").isin(PARSED, REPAIRED, FALLBACK), made)


def fallback_record(text: Column, note: Column) -> Column:
    """The record that stands for a reply which could not be read."""
    na = F.lit("N/A")
    none = lambda ddl: F.from_json(F.lit("[]"), ddl)
    strings = none("array<string>")
    return F.struct(
        F.struct(F.lit(FALLBACK_TITLE).alias("title"), F.lit("Unknown").alias("type"), na.alias("reference_number"), na.alias("date"), na.alias("authority")).alias("document_info"),
        F.struct(
            F.lit(FALLBACK_PURPOSE).alias("purpose"),
            F.concat(F.lit("JSON parsing failed: "), note, F.lit(". Raw response content is provided in full_text_content.")).alias("summary"),
            F.array(F.lit("JSON parsing failed"), F.lit("Raw content available in full_text_content"), F.concat(F.lit("Error: "), note)).alias("key_points"),
        ).alias("main_content"),
        none("array<struct<section_title:string,content:string,key_details:array<string>>>").alias("detailed_sections"),
        none("array<struct<rule:string,details:string,applies_to:string>>").alias("rules_and_provisions"),
        none("array<struct<violation:string,penalty:string,amount:string,conditions:string>>").alias("penalties_and_consequences"),
        F.struct(*[strings.alias(k) for k in ("people", "organizations", "locations", "amounts", "dates", "references")]).alias("important_entities"),
        strings.alias("action_items"),
        none("array<struct<term:string,definition:string>>").alias("definitions"),
        text.alias("full_text_content"),
    )


def typed(parsed: DataFrame, text_col: str = "response_text") -> DataFrame:
    """Adds ``record`` (null for error records) and ``is_error`` (no object, or an ``error`` key)."""
    is_error = (F.col("status") == NOT_OBJECT) | F.coalesce(F.array_contains(F.json_object_keys("json"), "error"), F.lit(False))
    read = F.from_json("json", RECORD)
    record = F.when(F.col("status") == FALLBACK, fallback_record(F.col(text_col), F.col("note"))).when(~is_error, read)
    return parsed.withColumns({"is_error": is_error, "record": record})
