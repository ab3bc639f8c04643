"""Counters, status lists and previews of runs; collisions and gaps in logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.strings import preview
from quillspark.functions.urls import stem


def statuses(records: DataFrame, keys: tuple[str, ...] = (), failure: Column | None = None) -> DataFrame:
    """``keys``, then ``file, status, output, method, error, preview`` of each record.

    A record with an error is written all the same and counts as a success; ``method`` is what
    the top level names, ``unknown`` where it names none. A record with a ``failure`` (it could not
    be processed or written) is ``failed``, with that as its error and neither output nor method.
    """
    name = F.coalesce("source_file", "file")
    failed = F.lit(None).cast("string") if failure is None else failure
    done = failed.isNull()
    return records.select(
        *keys,
        name.alias("file"),
        F.when(done, "success").otherwise("failed").alias("status"),
        F.when(done, F.concat(stem(name), F.lit("_extracted.json"))).alias("output"),
        F.when(done, F.coalesce("processing_method", F.lit("unknown"))).alias("method"),
        F.coalesce(failed, F.col("error")).alias("error"),
        F.when(done, preview(F.col("main_content.summary"))).alias("preview"),
    )


def run_summary(status_rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counters of a run; ``failed`` counts what raised, ``n_error_records`` what holds an error."""
    return status_rows.groupBy(*keys).agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status") == "success").alias("processed_successfully"),
        F.count_if(F.col("status") != "success").alias("failed"),
        F.count_if((F.col("status") == "success") & F.col("error").isNotNull()).alias("n_error_records"),
    )


def run_report(status_rows: DataFrame, started: Column, completed: Column) -> DataFrame:
    """The one row of a run's summary: counters, ``results`` and the stamps of start and end.

    ``results`` has a struct for each file, by name; a success names its output and method, a
    failure its error. The list goes into one document, as a summary does: a run's files, not a table's rows.
    """
    failed = F.col("status") != "success"
    one = F.struct("file", "status", "output", "method", F.when(failed, F.col("error")).alias("error"))
    return status_rows.agg(
        F.count("*").cast("int").alias("total_files"),
        F.count_if(~failed).cast("int").alias("processed_successfully"),
        F.count_if(failed).cast("int").alias("failed"),
        F.array_sort(F.collect_list(one)).alias("results"),
        F.first(started).alias("processing_started"),
        F.first(completed).alias("processing_completed"),
    )


def download_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of a download: ``total, successful, failed, n_bytes``."""
    ok = F.col("status") == "success"
    return outcomes.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


def name_collisions(log: DataFrame) -> DataFrame:
    """Saved names that stand for more than one source, whose files would overwrite each other."""
    return log.groupBy("saved_filename").agg(F.countDistinct("source_url").alias("n_sources"), F.count("*").alias("n_rows")).filter("n_sources > 1 or n_rows > 1")


def reconcile(acts: DataFrame, viewed: DataFrame, downloaded: DataFrame, key: str = "act_title") -> DataFrame:
    """For each act whether it is in the viewing log, in the download log, or in neither."""
    seen = viewed.select(key).distinct().withColumn("in_view", F.lit(True))
    got = downloaded.select(key).distinct().withColumn("in_download", F.lit(True))
    return acts.select(key).distinct().join(seen, key, "left").join(got, key, "left").select(key, F.coalesce("in_view", F.lit(False)).alias("in_view"), F.coalesce("in_download", F.lit(False)).alias("in_download"))
