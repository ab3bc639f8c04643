"""Document files: inventory, kinds, texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.urls import stem


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, modificationTime, length, content`` of the files of a folder, not of its subfolders."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)


def inventory(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds ``file_name, file_stem, is_pdf`` (by its first bytes, whatever the name says)."""
    name = F.substring_index(path_col, "/", -1)
    return files.withColumns({"file_name": name, "file_stem": stem(name), "is_pdf": F.coalesce(F.hex(F.substring("content", 1, 5)) == "255044462D", F.lit(False))})


def read_pdf(content: bytes) -> str:
    """The text of a PDF's pages; raises where no PDF library is installed."""
    from io import BytesIO

    from pypdf import PdfReader

    return "".join((p.extract_text() or "") + "\n" for p in PdfReader(BytesIO(content)).pages).strip()


def texts(files: DataFrame, reader: Callable[[bytes], str] = read_pdf) -> DataFrame:
    """``path, text, error``: a file that cannot be read has an empty text and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    out.append((p, reader(bytes(c)), None))
                except Exception as e:  # one bad file does not end the run
                    out.append((p, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")
