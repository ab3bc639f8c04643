"""Pages from the network behind an interface; offline, pages come from a table.

``fetch`` takes a fetcher made once in each partition (one session each). The default
``TableFetcher`` does not exist: offline a page is looked up by an equi-join, so nothing leaves
the cluster. ``http_fetcher`` is the live one; it is not run in tests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetcher = Callable[[str], bytes]


def lookup(urls: DataFrame, pages: DataFrame, url_col: str) -> DataFrame:
    """Rows with the page they name; rows whose page is missing are dropped, as a failed fetch drops them."""
    return urls.join(pages.select(F.col("url").alias(url_col), "html"), url_col)


def http_fetcher(timeout: float = 20.0, agent: str = "Mozilla/5.0") -> Fetcher:
    """A fetcher over the standard library; raises on errors and on statuses that are no success."""
    import urllib.request

    opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor())
    opener.addheaders = [("User-Agent", agent), ("Accept", "text/html,application/xhtml+xml"), ("Accept-Language", "en"), ("Connection", "keep-alive")]

    def get(url: str) -> bytes:
        with opener.open(url, timeout=timeout) as r:
            return r.read()

    return get


def listing(url: str, make_fetcher: Callable[[], Fetcher]) -> str:
    """The text of the one page that a run starts from; a failure ends the run and says why."""
    try:
        return make_fetcher()(url).decode("utf-8", "replace")
    except Exception as e:
        raise RuntimeError(f"the listing {url} could not be read: {type(e).__name__}: {e}") from e


def fetch(urls: DataFrame, make_fetcher: Callable[[], Fetcher], delay: float = 0.0, url_col: str = "url") -> DataFrame:
    """``url, body, error``; errors stay with their row, ``delay`` seconds pass between two of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, first = make_fetcher(), True
        for b in batches:
            out = []
            for u in b[url_col]:
                if delay and not first:
                    time.sleep(delay)
                first = False
                try:
                    out.append((u, get(u), None))
                except Exception as e:  # isolated by row
                    out.append((u, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "body", "error"])

    return urls.select(url_col).mapInPandas(run, "url string, body binary, error string")
