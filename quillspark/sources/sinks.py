"""Sinks: CSV logs, one JSON file a document, the run summary, downloaded files.

Writers are idempotent: a task that is run again writes the same bytes under the same name,
first to a name of its own and then moved into place.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIEW_HEADER = {"act_title": "Act Title", "page_url": "Page URL", "link_type": "Link Type", "viewer_url": "Viewer URL"}
DOWNLOAD_HEADER = {"act_title": "Act Title", "saved_filename": "Saved Filename", "source_url": "Source URL"}


def write_log(rows: DataFrame, header: dict[str, str], folder: str) -> bool:
    """A CSV log with a header and doubled quotes; nothing is written for no rows."""
    named = rows.select(*[F.col(c).alias(h) for c, h in header.items()])
    if named.isEmpty():
        return False
    named.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(folder)
    return True


def as_json(record: DataFrame, pretty: bool = True) -> DataFrame:
    """``json``: each row as an object, nulls kept."""
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    return record.select(F.to_json(F.struct("*"), options).alias("json"))


def _put(folder: str, name: str, data: bytes) -> None:
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, os.path.join(folder, name))


def write_documents(records: DataFrame, folder: str, stem_col: str = "file_stem") -> DataFrame:
    """Writes ``{stem}_extracted.json`` for each record into a folder that all executors share.

    Returns ``name, n_bytes, error``; the files exist once the result has been read. A record that
    cannot be written says why and does not end the run.
    """
    options = {"ignoreNullFields": "false", "pretty": "true"}
    body = [c for c in records.columns if c != stem_col]
    rows = records.select(F.col(stem_col).alias("stem"), F.to_json(F.struct(*body), options).alias("json"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, j in zip(b["stem"], b["json"]):
                name = f"{s}_extracted.json"
                try:
                    data = j.encode("utf-8", "replace")
                    _put(folder, name, data)
                    out.append((name, len(data), None))
                except OSError as e:  # isolated by row
                    out.append((name, 0, f"{type(e).__name__}: {e.strerror}"))
            yield pd.DataFrame(out, columns=["name", "n_bytes", "error"])

    return rows.mapInPandas(run, "name string, n_bytes bigint, error string")


def write_summary(summary: DataFrame, folder: str) -> None:
    """``extraction_summary.json``: the one row of a run summary."""
    row = as_json(summary).first()
    _put(folder, "extraction_summary.json", (row["json"] if row else "{}").encode())


def download(targets: DataFrame, folder: str, make_fetcher: Callable[[], Callable[[str], bytes]]) -> DataFrame:
    """Saves ``source_url`` as ``saved_filename``; ``saved_filename, status, n_bytes, error`` for each.

    Names that occur for several sources get a hash of their source before the suffix, so that
    no file overwrites another. Names are counted by partial aggregates, so a default name that
    a large part of all links has is no burden.
    """
    one = targets.select("source_url", "saved_filename").distinct()
    shared = one.groupBy("saved_filename").agg((F.min("source_url") < F.max("source_url")).alias("shared"))
    own = F.concat(F.regexp_replace("saved_filename", r"(?<=.)\.[^.]+\z", ""), F.lit("_"), F.lower(F.hex(F.xxhash64("source_url"))), F.regexp_extract("saved_filename", r"(?<=.)(\.[^.]+)\z", 1))
    named = one.join(shared, "saved_filename").select("source_url", F.when(F.col("shared"), own).otherwise(F.col("saved_filename")).alias("saved_filename"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = make_fetcher()
        for b in batches:
            out = []
            for u, n in zip(b["source_url"], b["saved_filename"]):
                try:
                    data = get(u)
                    _put(folder, n, data)
                    out.append((n, "success", len(data), None))
                except Exception as e:  # isolated by row
                    out.append((n, "failed", 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["saved_filename", "status", "n_bytes", "error"])

    return named.mapInPandas(run, "saved_filename string, status string, n_bytes bigint, error string")
