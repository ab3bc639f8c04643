"""The whole run: documents to prompts, replies, records, one record for each document, a summary.

Documents are routed by filters, not by a ``CASE`` over Python functions (those would run for
every row): a document whose file the model takes directly is one prompt; one with text up to
``max_chars`` is one prompt; a longer one goes by its chunks, or, where it has no boundary, by
its first ``max_chars`` characters; one without text is an error record. A direct call that fails
is followed by the calls of the document's text. Each prompt goes to the model once: replies are
written before anything is read from them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import chunking, jsonrepair, merge, report
from quillspark.session import cut
from quillspark.sources.extract import Model, extract, offline_model
from quillspark.sources.files import inventory, read_pdf, scan, texts
from quillspark.sources.sinks import write_documents, write_summary

DIRECT, TEXT, CHUNK, TRUNCATED, EMPTY = "direct_upload", "text_extraction", "chunk", "text_truncated", "empty"


@dataclass(frozen=True)
class Settings:
    """What a run can be told; nothing is asked for or read from the environment."""

    prompt: str = "Extract the record as one JSON object."
    max_chars: int = 100_000
    #: Seconds between two calls of a task.
    delay_seconds: float = 0.0
    output_folder: str | None = None


def is_suspect(url: Column, content_type: Column) -> Column:
    """Whether neither the address nor the content type speaks of a PDF."""
    return ~(F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf")) | F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit("pdf")))


def route(documents: DataFrame, settings: Settings, direct_col: str | None = None) -> DataFrame:
    """``doc_id, method, chunk_no, n_chunks, chunk``: a row for each call, and one for each document without text.

    Documents are scanned once: each gives an array of calls, which is exploded.
    """
    limit = F.lit(settings.max_chars)
    text = F.coalesce(F.col("text"), F.lit(""))
    direct = F.coalesce(F.col(direct_col), F.lit(False)) if direct_col else F.lit(False)
    rows = documents.select("doc_id", text.alias("text"), direct.alias("direct"))
    # the fold over paragraphs runs for long texts only and once for each
    long_ = ~F.col("direct") & (F.length("text") > limit)
    chunked = rows.withColumn("chunks", F.when(long_, chunking.chunks(F.col("text"), limit)))
    by_method = (
        F.when(F.col("direct"), DIRECT)
        .when(F.col("text") == "", EMPTY)
        .when(F.col("chunks").isNull(), TEXT)
        .when(F.size("chunks") <= 1, TRUNCATED)
        .otherwise(CHUNK)
    )
    said = (
        F.when(F.col("method") == EMPTY, F.array(F.lit(None).cast("string")))
        .when(F.col("method") == TRUNCATED, F.array(F.concat(F.left("text", limit), F.lit(chunking.TRUNCATED))))
        .when(F.col("method") == CHUNK, F.col("chunks"))
        .otherwise(F.array("text"))
    )
    calls = chunked.withColumn("method", by_method).select("doc_id", "method", said.alias("said"))
    one = calls.select("doc_id", "method", F.size("said").alias("n_chunks"), F.posexplode("said").alias("pos", "chunk"))
    number = (F.col("pos") + 1).alias("chunk_no")
    named = F.when(F.col("method") == CHUNK, F.concat(F.lit(f"{CHUNK}_"), (F.col("pos") + 1).cast("string"))).otherwise(F.col("method"))
    return one.select("doc_id", named.alias("method"), number, "n_chunks", "chunk")


def ask(documents: DataFrame, settings: Settings, make_model: Callable[[], Model] = offline_model, direct_col: str | None = None) -> DataFrame:
    """The calls with ``response_text`` and ``call_error``, written once; failed direct calls are replaced by calls of the text."""
    calls = route(documents, settings, direct_col)
    asked = cut(extract(chunking.prompts(calls, settings.prompt), make_model, delay=settings.delay_seconds, skip=F.col("method") == EMPTY))
    if direct_col is None:
        return asked
    failed = asked.filter((F.col("method") == DIRECT) & F.col("call_error").isNotNull()).select("doc_id")
    again = route(documents.join(failed, "doc_id", "left_semi"), settings)
    retried = cut(extract(chunking.prompts(again, settings.prompt), make_model, delay=settings.delay_seconds, skip=F.col("method") == EMPTY))
    return asked.filter((F.col("method") != DIRECT) | F.col("call_error").isNull()).unionByName(retried)


def run(documents: DataFrame, settings: Settings | None = None, make_model: Callable[[], Model] = offline_model, direct_col: str | None = None) -> DataFrame:
    """One row for each document: its record, ``method_resolved``, ``error`` and ``_metadata``.

    ``_metadata`` is that of the document's only reply; a document of several chunks has none, as
    its record names its method itself.
    """
    settings = settings or Settings()
    typed = jsonrepair.typed(jsonrepair.parse_replies(ask(documents, settings, make_model, direct_col)))
    empty = F.col("method") == EMPTY
    failed = F.col("call_error").isNotNull() | F.coalesce(F.col("is_error"), F.lit(True))
    own = typed.withColumns({"metadata_": jsonrepair.metadata(), "failed_": failed, "empty_": empty})
    more = (
        F.when(F.min("empty_"), F.lit(None)).when(F.max("n_chunks") > 1, F.lit("multi_chunk")).otherwise(F.min("method_resolved")).alias("method_resolved"),
        F.when(F.min("empty_"), F.lit("no text")).when(F.min("failed_"), F.coalesce(F.min("call_error"), F.lit("the reply is no record"))).alias("error"),
        F.when(F.max("n_chunks") == 1, F.first("metadata_", ignorenulls=True)).alias("_metadata"),
    )
    # one aggregation for the record and for what became of the calls
    records = merge.merge_chunks(own, more=more)
    blank = F.col("error") == "no text"
    body = [c for c in records.columns if c not in ("doc_id", "method_resolved", "error")]
    return records.select("doc_id", *[F.when(blank.isNull() | ~blank, F.col(c)).alias(c) for c in body], "method_resolved", "error")


def run_folder(spark: SparkSession, folder: str, settings: Settings, make_model: Callable[[], Model] = offline_model, reader: Callable[[bytes], str] = read_pdf, direct: Column | None = None) -> DataFrame:
    """A folder of PDF files in, a JSON file for each and ``extraction_summary.json`` out; returns the summary's row.

    ``direct`` says which files the model takes directly (by their content's columns); their text is
    read all the same, in case that fails. A file whose record cannot be written is ``failed``.
    """
    if not settings.output_folder:
        raise ValueError("a run over a folder needs an output folder")
    started = stamp_now()
    files = inventory(scan(spark, folder))
    read = texts(files, reader).select("path", "text")
    documents = cut(files.drop("content").withColumn("direct", F.lit(False) if direct is None else direct).join(read, "path").withColumnRenamed("path", "doc_id"))
    if documents.isEmpty():
        return spark.createDataFrame([("No PDF files found",)], "error string")
    done = run(documents, settings, make_model, "direct")
    named = done.join(documents.select("doc_id", F.col("file_name").alias("source_file"), F.col("length").alias("file_size_bytes"), "file_stem"), "doc_id")
    records = cut(named.withColumns({"extraction_timestamp": jsonrepair.stamp(), "file": F.col("source_file")}))
    written = cut(write_documents(records.drop("doc_id", "method_resolved"), settings.output_folder))
    outcome = records.withColumn("name", F.concat("file_stem", F.lit("_extracted.json"))).join(written.select("name", F.col("error").alias("failure")), "name")
    summary = report.run_report(report.statuses(outcome, (), F.col("failure")), F.lit(started), F.lit(stamp_now()))
    write_summary(cut(summary), settings.output_folder)
    return summary


def stamp_now() -> str:
    return time.strftime("%Y-%m-%d %H:%M:%S")
