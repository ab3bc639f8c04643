"""Links of pages: extraction, predicates, onclick and script targets, order and duplicates.

Tags are read natively: comments and the bodies of scripts and styles are taken out first, an
attribute may be in double, in single or in no quotes, and character references in values are
decoded. Where nesting matters (tables, lists, descendants) ``operators.html`` parses the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.strings import unescape

#: The inside of a tag: quoted values may hold ``>``.
_INSIDE = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
QUOTED_PDF = r"""(?iu)['"]([^'"]*\.pdf[^'"]*)['"]"""
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"


def visible(html: Column) -> Column:
    """A page without comments, scripts and styles, whose text is no markup."""
    return F.regexp_replace(html, _HIDDEN, "")


def tags(html: Column, names: str = r"[a-z][a-z0-9]*") -> Column:
    """The start tags of the named elements (a pattern), in document order."""
    return F.regexp_extract_all(visible(html), F.lit(rf"(?is)<(?:{names})(?=[\s/>]){_INSIDE}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, decoded; null if the tag has none."""
    # earlier attributes are passed over whole, so that a name inside a quoted value is none
    before = r"""(?is)^<[^\s/>]+(?:[\s/]+[^\s=/>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?[\s/]+"""
    value = lambda k: F.regexp_extract(tag, rf"""{before}{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", k)
    bare = F.when(tag.rlike(rf"{before}{name}(?=[\s/>])"), F.lit(""))
    return F.when(tag.rlike(rf"{before}{name}\s*="), unescape(F.concat(value(1), value(2), value(3)))).otherwise(bare)


def hrefs(html: Column) -> Column:
    """The ``href`` of every anchor in document order, duplicates kept."""
    return F.filter(F.transform(tags(html, "a"), lambda t: attribute(t, "href")), lambda h: h.isNotNull())


def is_pdf_link(href: Column, mode: str = "contains") -> Column:
    """``contains``: ``pdf`` anywhere in the raw link; ``suffix``: the path ends in ``.pdf``."""
    if mode == "contains":
        return F.contains(F.lower(href), F.lit("pdf"))
    return F.regexp_replace(F.lower(href), r"[?#].*\z", "").endswith(".pdf")


def _quoted_in(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda x: F.regexp_extract_all(x, F.lit(QUOTED_PDF), F.lit(1))))


def onclick_targets(html: Column) -> Column:
    """Quoted ``.pdf`` strings in ``onclick`` attributes of any element."""
    handlers = F.transform(F.filter(tags(html), lambda t: F.contains(F.lower(t), F.lit("onclick"))), lambda t: attribute(t, "onclick"))
    return _quoted_in(F.filter(handlers, lambda x: F.contains(F.lower(x), F.lit(".pdf"))))


def script_targets(html: Column) -> Column:
    """Quoted ``.pdf`` strings with a slash in script bodies."""
    return F.filter(_quoted_in(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))), lambda x: F.contains(x, F.lit("/")))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, pos, href``; a narrow stage, no shuffle."""
    return pages.select("page_id", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


def pdf_targets(pages: DataFrame, absolute) -> DataFrame:
    """``page_id, pos, target``: PDF links, then onclick targets not seen before on the page.

    ``absolute(url, href)`` resolves a link. The filter runs on the array, before rows are made.
    """
    url = F.col("url")
    links = F.transform(F.filter(hrefs(F.col("html")), lambda h: is_pdf_link(h)), lambda h: absolute(url, h))
    clicks = F.array_distinct(F.transform(onclick_targets(F.col("html")), lambda h: absolute(url, h)))
    targets = F.concat(links, F.array_except(clicks, links))
    return pages.select("page_id", F.posexplode(targets).alias("pos", "target"))


def first_seen(links: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by ``order``; pre-aggregated before the shuffle, so hot keys are no burden."""
    first = F.min(F.struct(*order)).alias("first")
    return links.filter(F.col(key).isNotNull()).groupBy(key).agg(first, F.count("*").alias("n_seen")).select(key, *[F.col(f"first.{c}").alias(c) for c in order], "n_seen")
