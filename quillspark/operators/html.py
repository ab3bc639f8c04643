"""Structure of listing pages: tables, containers, next pages, pagination.

Selections that depend on nesting come from one parse of a page (``elements``, in Arrow batches):
each element with its parent, attributes and text. What follows is expressions over that array.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TEXT, _PLACE = T.StringType(), T.IntegerType()
ELEMENTS = T.ArrayType(
    T.StructType(
        [T.StructField("tag", _TEXT), T.StructField("parent", _PLACE), T.StructField("path", T.ArrayType(_PLACE)), T.StructField("attrs", T.MapType(_TEXT, _TEXT)), T.StructField("text", _TEXT)]
    )
)


class _Reader(HTMLParser):
    """Elements in document order; text goes to all open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[int] = []
        self.texts: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kept: dict[str, str] = {}
        for name, value in attrs:
            kept.setdefault(name, value or "")
        self.found.append({"tag": tag, "parent": self.open[-1] if self.open else -1, "path": list(self.open), "attrs": kept})
        self.texts.append([])
        if tag not in VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[k]]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        for k in self.open:
            self.texts[k].append(data)

    def result(self) -> list[dict]:
        return [x | {"text": "".join(t).replace("\u00a0", " ").strip()} for x, t in zip(self.found, self.texts)]


def read(html: str | None) -> list[dict] | None:
    """The elements of a page; null for a null page."""
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.result()


@F.pandas_udf(ELEMENTS)
def elements(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``tag, parent, path, attrs, text`` of each element in document order; ``path`` holds the places of all elements around it."""
    for batch in pages:
        yield batch.map(read)


def parsed(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``elements``; pages are parsed once, whatever is selected from them."""
    return pages.withColumn("elements", elements(html_col))


def _has_class(e: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(e["attrs"]["class"], F.lit("")), r"\s+"), name)


def _first_place(found: Column, test) -> Column:
    """The place of the first element that passes; null if none does."""
    at = F.transform(found, lambda e, i: F.when(test(e), i))
    return F.array_min(F.filter(at, lambda i: i.isNotNull()))


def _within(found: Column, place: Column, tag: str) -> Column:
    """``array<struct<i, e>>``: the elements of a tag anywhere inside the element at a place."""
    numbered = F.transform(found, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    return F.filter(numbered, lambda x: (x["e"]["tag"] == tag) & F.array_contains(x["e"]["path"], place))


def _links(anchors: Column) -> Column:
    kept = F.filter(anchors, lambda x: x["e"]["attrs"]["href"].isNotNull())
    return F.transform(kept, lambda x: F.struct(x["e"]["attrs"]["href"].alias("href"), x["e"]["text"].alias("text")))


def anchors(found: Column) -> Column:
    """``array<struct<href, text>>`` of the anchors with a link."""
    return _links(F.filter(F.transform(found, lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda x: x["e"]["tag"] == "a"))


def container_links(found: Column, element: str, id_: str) -> Column:
    """The anchors inside the element with an id, however deep; null if the page has no such element."""
    place = _first_place(found, lambda e: (e["tag"] == element) & (e["attrs"]["id"] == id_))
    return F.when(place.isNotNull(), _links(_within(found, place, "a")))


def panel_links(found: Column, table_class: str = "panel", cells: int = 4) -> Column:
    """The first link in the fourth cell of each row of the panel table that has as many cells.

    Rows and cells are those inside the table at any depth, as a cell may hold a table of its own.
    """
    place = _first_place(found, lambda e: (e["tag"] == "table") & _has_class(e, table_class))
    rows = _within(found, place, "tr")

    def link(row: Column) -> Column:
        own = _within(found, row["i"], "td")
        cell = F.get(own, F.lit(cells - 1))
        inside = F.filter(_within(found, cell["i"], "a"), lambda a: a["e"]["attrs"]["href"].isNotNull())
        return F.when(F.size(own) >= cells, F.get(inside, F.lit(0))["e"]["attrs"]["href"])

    return F.filter(F.transform(rows, link), lambda h: h.isNotNull())


def missing_container(found: Column, element: str, id_: str) -> Column:
    """What the report says of a page without its container; null if the page has it or could not be read."""
    place = _first_place(found, lambda e: (e["tag"] == element) & (e["attrs"]["id"] == id_))
    return F.when(found.isNotNull() & place.isNull(), F.lit(f"no {element} with id {id_}"))


def next_page(found: Column) -> Column:
    """The link of the first anchor titled ``Next Page``; null if there is none or it has no link."""
    own = F.filter(found, lambda e: (e["tag"] == "a") & (e["attrs"]["title"] == "Next Page"))
    return F.nullif(F.get(own, F.lit(0))["attrs"]["href"], F.lit(""))


def numbered_pages(found: Column) -> Column:
    """Links whose text is a number above 1, of any script's digits."""
    digits = F.filter(anchors(found), lambda a: a["text"].rlike(r"^\p{Nd}+$"))
    # 1 in any script is one digit of value 1 behind zeros; zeros alone are no page
    return F.transform(F.filter(digits, lambda a: ~_small_number(a["text"])), lambda a: a["href"])


def _small_number(digits: Column) -> Column:
    """Whether digits of any script say 0 or 1: in each block of ten digits those are the first two."""
    zeros = "0٠۰०০੦૦୦௦౦೦൦๐"
    ones = "1١۱१১੧૧୧௧౧೧൧๑"
    return digits.rlike(f"^[{zeros}]*[{zeros}{ones}]$")


#: The marks of pagination links, in order of priority: part of a link, class around an anchor, relation, part of a text.
PAGINATION = (
    ("href", "page"), ("href", "p="), ("href", "offset"), ("href", "start"),
    ("inside", "pagination"), ("inside", "pager"), ("inside", "page-numbers"),
    ("rel", "next"), ("text", "Next"), ("text", ">"), ("text", "→"), ("href", "next"),
)


def pagination_links(found: Column) -> Column:
    """Links that page on, each once: by the marks in their order, then numbered ones."""
    own = F.filter(F.transform(found, lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda x: (x["e"]["tag"] == "a") & (x["e"]["attrs"]["href"] != ""))

    def marked(kind: str, mark: str) -> Column:
        if kind == "inside":
            classed = F.filter(F.transform(found, lambda e, i: F.when(_has_class(e, mark), i)), lambda i: i.isNotNull())
            some = F.filter(own, lambda x: F.arrays_overlap(x["e"]["path"], classed))
        elif kind == "rel":
            some = F.filter(own, lambda x: x["e"]["attrs"]["rel"] == mark)
        elif kind == "text":
            some = F.filter(own, lambda x: F.contains(x["e"]["text"], F.lit(mark)))
        else:
            some = F.filter(own, lambda x: F.contains(x["e"]["attrs"]["href"], F.lit(mark)))
        return F.transform(some, lambda x: x["e"]["attrs"]["href"])

    return F.array_distinct(F.concat(*[marked(*m) for m in PAGINATION], F.filter(numbered_pages(found), lambda h: h != "")))
