"""URL algebra as native expressions: resolution, parts, file names, pagination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def origin(url: Column) -> Column:
    """Scheme and authority, ``""`` if there are none."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?", 0)


def path(url: Column) -> Column:
    """The path, without query, fragment and the last segment's parameters."""
    raw = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*\z", "")


def _no_dots(p: Column) -> Column:
    """``.`` and ``..`` segments folded."""
    parts = F.split(p, "/", -1)

    def step(acc: Column, s: Column) -> Column:
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(s == "..", popped).when(s == ".", acc).otherwise(F.array_append(acc, s))

    folded = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    last = F.element_at(parts, -1)
    closed = F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)
    return F.when(p.startswith("/"), F.array_join(closed, "/")).otherwise(p)


def resolve(base: Column, href: Column) -> Column:
    """``href`` seen from the page ``base`` (RFC 3986); null for a null ``href``."""
    no_fragment = F.regexp_replace(base, r"#.*\z", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*\z", "")
    head = origin(base)
    own = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.substring(href, F.length(own) + 1, F.length(href))
    base_path = F.substring(no_query, F.length(head) + 1, F.length(no_query))
    folder = F.regexp_extract(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"^.*/", 0)
    return (
        F.when(href.isNull(), F.lit(None).cast("string"))
        .when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 0), href))
        .when(href.startswith("/"), F.concat(head, _no_dots(own), tail))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .otherwise(F.concat(head, _no_dots(F.concat(folder, own)), tail))
    )


def prefixed(site: str, href: Column) -> Column:
    """``href`` behind the site's address unless it starts with ``http``; no slash is mended."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))


def with_scheme(url: Column) -> Column:
    """``https://`` before an address without ``http://`` or ``https://``."""
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def base_name(url: Column) -> Column:
    """The last segment of the path."""
    return F.substring_index(path(url), "/", -1)


def saved_name(url: Column, pos: Column, any_case: bool = False) -> Column:
    """The name to save under: the last segment if it ends in ``.pdf``, else by the place from 1 on."""
    name = base_name(url)
    tested = F.lower(name) if any_case else name
    return F.when(tested.endswith(".pdf"), name).otherwise(F.concat(F.lit("document_"), (pos + 1).cast("string"), F.lit(".pdf")))


def unquoted_name(url: Column) -> Column:
    """What follows the last slash, query included; valid percent escapes are decoded, others stay as they are."""
    raw = F.substring_index(url, "/", -1)
    whole = F.regexp_replace(F.replace(raw, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(whole), raw)


def safe_name(name: Column) -> Column:
    """Characters that a file name may not hold as ``_``."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def joined(folder: str, name: Column) -> Column:
    return F.concat_ws("/", F.lit(folder), name)


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def page_urls(url: Column, max_pages: Column) -> Column:
    """Guessed addresses of pages 2 to ``max_pages``, five at most: all ``page=N``, then all ``/page/N``.

    The query form keeps path and fragment and adds to the query; the path form keeps query and fragment.
    """
    fragment = F.regexp_extract(url, r"#.+\z", 0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    plain = F.regexp_replace(url, r"[?#].*\z", "")
    asked = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    folder = F.when(plain.endswith("/"), plain).otherwise(F.concat(plain, F.lit("/")))
    last = F.least(max_pages, F.lit(5))
    numbers = F.when(last >= 2, F.sequence(F.lit(2), F.greatest(last, F.lit(2)))).otherwise(F.array().cast("array<int>"))
    more = F.when(query == "", F.lit("")).otherwise(F.concat(query, F.lit("&")))
    by_query = F.transform(numbers, lambda n: F.concat(plain, F.lit("?"), more, F.lit("page="), n.cast("string"), fragment))
    by_path = F.transform(numbers, lambda n: F.concat(folder, F.lit("page/"), n.cast("string"), asked, fragment))
    return F.concat(by_query, by_path)


def clamp_pages(text: Column) -> Column:
    """A page budget between 1 and 20; 5 where it is no number."""
    return F.greatest(F.least(F.coalesce(text.try_cast("int"), F.lit(5)), F.lit(20)), F.lit(1))


def clamp_delay(text: Column) -> Column:
    """A delay of a second at least; 2 where it is no number."""
    return F.greatest(F.coalesce(text.try_cast("double"), F.lit(2.0)), F.lit(1.0))
