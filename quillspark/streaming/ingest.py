"""Incremental ingest of document files and of event-time logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.files import inventory


def new_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """A stream of files that have not been seen, with their names and kinds."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return inventory(spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema(schema).load(folder))


def ingest(stream: DataFrame, table_path: str, checkpoint: str):
    """Appends a stream to a Parquet table once for all that is there, and ends."""
    return stream.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def downloads_by_window(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Downloads and distinct names in each window of ``logged_at``; rows later than the watermark are left out of closed windows."""
    return log.withWatermark("logged_at", late).groupBy(F.window("logged_at", window)).agg(F.count("*").alias("n_rows"), F.approx_count_distinct("saved_filename").alias("n_names"))
