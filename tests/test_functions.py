from urllib.parse import unquote, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from quillspark.functions import strings, urls


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


BASES = ["https://h.example/a/b/c.html?x=1#f", "http://h.example", "https://h.example/a/", "https://h.example/index"]
LINKS = ["", "?p=2", "#f", "//o.example/x", "../c.pdf", "../../../c.pdf", "./d", "e/f.pdf", "/g/../h.pdf", "/g/./h", "mailto:a@b", "javascript:void(0)", "https://q.example/z?y#w", "a b.pdf", "x/..", "..", "."]


@pytest.mark.parametrize("base", BASES)
def test_resolve_is_urljoin(spark, base):
    rows = [(base, h) for h in LINKS]
    got = values(spark, rows, "b string, h string", urls.resolve(F.col("b"), F.col("h")))
    assert [g[0] for g in got] == [urljoin(base, h) for h in LINKS]


def test_resolve_null(spark):
    assert values(spark, [("http://h/a", None)], "b string, h string", urls.resolve(F.col("b"), F.col("h"))) == [(None,)]


def test_names(spark):
    rows = [("https://h/a/b.pdf?x=1", 0), ("https://h/a/", 1), ("https://h/B.PDF", 2), ("https://h/a%20b+c.pdf", 3), ("https://h/a%zz.pdf", 4), ("https://h/a;v=1.pdf", 5), ("https://h", 6)]
    got = values(spark, rows, "u string, pos int", urls.base_name(F.col("u")), urls.saved_name(F.col("u"), F.col("pos")), urls.saved_name(F.col("u"), F.col("pos"), True), urls.unquoted_name(F.col("u")))
    for (u, pos), (base, saved, any_case, raw) in zip(rows, got):
        want = urlparse(u).path.rpartition("/")[2]
        assert base == want
        assert saved == (want if want.endswith(".pdf") else f"document_{pos + 1}.pdf")
        assert any_case == (want if want.lower().endswith(".pdf") else f"document_{pos + 1}.pdf")
        assert raw == unquote(u.rpartition("/")[2])


def test_squeeze_name(spark):
    got = values(spark, [('The  "Water/Land" Act?',), ("x" * 200,), (None,)], "t string", strings.squeeze_name(F.col("t")))
    assert got == [("The_WaterLand_Act.pdf",), ("x" * 150 + ".pdf",), (None,)]


def test_small_functions(spark):
    row = spark.createDataFrame([(" YES\n", "x", "", "7.5", "a.b.pdf", "h.example", "99", "0.2")], "y string, n string, e string, f string, s string, u string, p string, d string")
    got = row.select(
        strings.yes(F.col("y")), strings.yes(F.col("n")), strings.preview(F.col("e")), strings.preview(F.col("n")), strings.number_or(F.col("f"), 3.0), strings.number_or(F.col("n"), 3.0),
        urls.stem(F.col("s")), urls.with_scheme(F.col("u")), urls.clamp_pages(F.col("p")), urls.clamp_pages(F.col("n")), urls.clamp_delay(F.col("d")), urls.safe_name(F.lit('a<b>"c|d')), urls.joined("x", F.col("s")),
    ).first()
    assert tuple(got) == (True, False, None, "x...", 7.5, 3.0, "a.b", "https://h.example", 20, 5, 1.0, "a_b__c_d", "x/a.b.pdf")


def test_page_urls(spark):
    got = values(spark, [("http://h/a?q=1#z", 3), ("http://h/a/", 1)], "u string, m int", urls.page_urls(F.col("u"), F.col("m")))
    assert got[0][0] == ["http://h/a?q=1&page=2#z", "http://h/a?q=1&page=3#z", "http://h/a/page/2?q=1#z", "http://h/a/page/3?q=1#z"]
    assert got[1][0] == []


def test_unescape(spark):
    import html

    rows = ["a &amp; b", "&lt;p&gt;", "&#39;&#x27;&#X20AC;", "&amp;#39;", "&nbsp;x", "& &; &zzz; &#; &#xZ;", "no", "", "&eacute;&mdash;&rarr;", "&#128512;", "&amp&", None]
    got = [r[0] for r in values(spark, [(i, x) for i, x in enumerate(rows)], "i int, t string", strings.unescape(F.col("t")))]
    want = [None if x is None else html.unescape(x) for x in rows]
    want[10] = "&amp&"  # references by name need their semicolon
    assert got == want


def test_unquote_keeps_bad_escapes(spark):
    rows = ["http://h/a%20b%zz.pdf", "http://h/100%", "http://h/%E0%B2%95+1?x=%41", "http://h/plain"]
    got = [r[0] for r in values(spark, [(u,) for u in rows], "u string", urls.unquoted_name(F.col("u")))]
    assert got == [unquote(u.rpartition("/")[2]) for u in rows]


def test_prompt_lines(spark):
    rows = [("a\nb\n\nc\n\n\nd", "a\nb\n\nc"), ("a", "a"), ("\n\nx", ""), ("", ""), ("a\n\n", "a")]
    assert [r[0] for r in values(spark, [(t,) for t, _ in rows], "t string", strings.prompt_lines(F.col("t")))] == [w for _, w in rows]
