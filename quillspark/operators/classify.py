"""What a detail page offers: a PDF, a drive file, an embedded viewer, or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.strings import squeeze_name
from quillspark.functions.urls import prefixed
from quillspark.operators.links import attribute, hrefs, tags

DIRECT, DRIVE, VIEWER, NOTHING = "Direct PDF", "Google Drive", "Scribd Viewer", "Not Found"


def _empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_pdf(html: Column, suffix: bool) -> Column:
    """The first link that contains ``.pdf`` (as written), or that ends in it in any case."""
    test = (lambda h: h.rlike(r"(?i)\.pdf\n?\z")) if suffix else (lambda h: F.contains(h, F.lit(".pdf")))
    return F.get(F.filter(hrefs(html), test), F.lit(0))


def drive_link(html: Column) -> Column:
    """The address of the first drive frame, else of the first drive anchor."""
    first = lambda own, name: F.get(F.filter(F.transform(own, lambda t: attribute(t, name)), lambda v: F.contains(v, F.lit("drive.google.com"))), F.lit(0))
    return F.coalesce(first(tags(html, "iframe|a"), "src"), first(tags(html, "a"), "href"))


def drive_id(url: Column) -> Column:
    return _empty_to_null(F.regexp_extract(url, r"/d/([a-zA-Z0-9_-]+)", 1))


def drive_download(file_id: Column) -> Column:
    return F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file_id)


def viewer(html: Column) -> Column:
    """The source of the first embedded viewer, ``""`` if it has none; null without a viewer."""
    own = F.filter(tags(html, "iframe"), lambda t: F.array_contains(F.split(F.coalesce(attribute(t, "class"), F.lit("")), r"\s+"), "scribd_iframe_embed"))
    return F.when(F.size(own) > 0, F.coalesce(attribute(F.get(own, F.lit(0)), "src"), F.lit("")))


def classify(pages: DataFrame, site: str = "") -> DataFrame:
    """Adds ``link_type, source_url, viewer_url``; the first kind that a page has wins.

    A drive link without a file id does not count, so that page may still have a viewer.
    """
    html = F.col("html")
    pdf = first_pdf(html, suffix=True)
    drive = drive_link(html)
    found = pages.withColumns({"pdf_": pdf, "drive_": drive, "viewer_": viewer(html)}).withColumn("id_", drive_id(F.col("drive_")))
    kind = F.when(F.col("pdf_").isNotNull(), DIRECT).when(F.col("id_").isNotNull(), DRIVE).when(F.col("viewer_").isNotNull(), VIEWER).otherwise(NOTHING)
    return (
        found.withColumn("link_type", kind)
        .withColumn("source_url", F.when(F.col("link_type") == DIRECT, prefixed(site, F.col("pdf_"))).when(F.col("link_type") == DRIVE, F.col("drive_")))
        .withColumn("download_url", F.when(F.col("link_type") == DIRECT, F.col("source_url")).when(F.col("link_type") == DRIVE, drive_download(F.col("id_"))))
        .withColumn("viewer_url", F.when(F.col("link_type") == VIEWER, F.col("viewer_")).when(F.col("link_type") == NOTHING, F.lit("N/A")))
        .drop("pdf_", "drive_", "viewer_", "id_")
    )


def view_rows(classified: DataFrame) -> DataFrame:
    """Rows of the viewing log: pages with a viewer or nothing."""
    return classified.filter(F.col("link_type").isin(VIEWER, NOTHING)).select("act_title", F.col("act_url").alias("page_url"), "link_type", "viewer_url")


def download_rows(classified: DataFrame) -> DataFrame:
    """Rows of the download log: pages with a PDF or a drive file, with the name it is saved under."""
    return classified.filter(F.col("link_type").isin(DIRECT, DRIVE)).select("act_title", squeeze_name(F.col("act_title")).alias("saved_filename"), "source_url")
