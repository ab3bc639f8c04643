import json
import os

from pyspark.sql import functions as F

from quillspark.operators import classify, crawl, html, links, report
from quillspark.sources import extract, fetch, files, sinks
from quillspark.streaming import ingest


def test_pdf_targets(spark):
    page = """<a href="/a.pdf">1</a><a HREF = "/a.pdf">2</a><a href="/x">3</a><b onclick="go('/b.pdf', '/a.pdf')"></b><b onclick="go('/b.pdf')"></b>"""
    df = spark.createDataFrame([(1, "http://h/", page), (2, "http://h/", None), (3, "http://h/", "")], "page_id int, url string, html string")
    got = [(r.page_id, r.pos, r.target) for r in links.pdf_targets(df, lambda u, h: h).orderBy("page_id", "pos").collect()]
    assert got == [(1, 0, "/a.pdf"), (1, 1, "/a.pdf"), (1, 2, "/b.pdf")]  # anchors keep duplicates, clicks do not


def test_first_seen(spark):
    df = spark.createDataFrame([(2, 0, "u"), (1, 5, "u"), (1, 3, "u"), (9, 9, None)], "page_id int, pos int, abs_url string")
    assert [tuple(r) for r in links.first_seen(df, "abs_url", ["page_id", "pos"]).collect()] == [("u", 1, 3, 3)]


def test_classify_cascade(spark):
    pages = [
        (1, '<a href="x.pdf?y">n</a><a href="/f/B.PDF">d</a><iframe src="https://drive.google.com/file/d/I-1/p"></iframe>'),
        (2, '<iframe src="https://drive.google.com/file/d/I_2/preview"></iframe>'),
        (3, '<a href="https://drive.google.com/open?id=3">g</a><iframe class="a scribd_iframe_embed" src="https://v/3"></iframe>'),
        (4, '<iframe class="scribd_iframe_embed"></iframe>'),
        (5, "nothing"),
        (6, None),
    ]
    df = spark.createDataFrame([(i, f"Act {i}", f"/{i}", h) for i, h in pages], "page_id int, act_title string, act_url string, html string")
    got = {r.page_id: r for r in classify.classify(df, "https://s").collect()}
    assert [got[i].link_type for i in range(1, 7)] == ["Direct PDF", "Google Drive", "Scribd Viewer", "Scribd Viewer", "Not Found", "Not Found"]
    assert got[1].source_url == "https://s/f/B.PDF" and got[2].download_url.endswith("id=I_2") and got[3].viewer_url == "https://v/3" and got[4].viewer_url == "" and got[5].viewer_url == "N/A"
    c = classify.classify(df, "https://s")
    assert classify.view_rows(c).count() + classify.download_rows(c).count() == len(pages)


def test_html(spark):
    page = """<table class="x panel"><tr><td>1</td><td>2</td><td>3</td><td><a href="/h/1">v</a></td></tr><tr><td>no</td></tr></table>
    <ul id="act_child_list"><li><a href="/a"> The&nbsp;<b>X</b> &amp; Y </a></li></ul><a href="/p2">2</a><a href="/p1">1</a><a class="next" href="/n">more</a><a title="Next Page" href="/next">n</a>"""
    e = F.col("elements")
    r = html.parsed(spark.createDataFrame([(page,)], "html string")).select(html.panel_links(e), html.container_links(e, "ul", "act_child_list"), html.numbered_pages(e), html.next_page(e), html.pagination_links(e), html.container_links(e, "ul", "none")).first()
    assert r[0] == ["/h/1"] and tuple(r[1][0]) == ("/a", "The X & Y") and r[2] == ["/p2"] and r[3] == "/next" and r[4] == ["/next", "/p2"] and r[5] is None


def test_closure_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "url string, next string")
    got = crawl.next_page_closure(edges, edges.select("url"), 50)
    assert sorted((r.url, r.depth) for r in got.filter("start = 'a'").collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert got.count() == 10


def test_bounded_crawl(spark):
    rows = [("a", 0, "b"), ("a", 1, "c"), ("a", 2, "d"), ("a", 3, "e"), ("b", 0, "a"), ("b", 1, "f"), ("c", 0, "f"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "url string, pos int, target string")
    starts = spark.createDataFrame([("a",)], "url string")
    assert [r.url for r in crawl.bounded_crawl(df, starts, 10).orderBy("rank").collect()] == ["a", "b", "c", "d", "f"]
    assert [r.url for r in crawl.bounded_crawl(df, starts, 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_reports(spark):
    log = spark.createDataFrame([("x.pdf", "u1"), ("x.pdf", "u2"), ("y.pdf", "u3")], "saved_filename string, source_url string")
    assert [tuple(r) for r in report.name_collisions(log).collect()] == [("x.pdf", 2, 2)]
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "act_title string")
    got = {r.act_title: (r.in_view, r.in_download) for r in report.reconcile(one("a", "b", "c"), one("a"), one("b")).collect()}
    assert got == {"a": (True, False), "b": (False, True), "c": (False, False)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([('a "q", b', "p", "Not Found", "N/A")], "act_title string, page_url string, link_type string, viewer_url string")
    assert sinks.write_log(rows, sinks.VIEW_HEADER, str(tmp_path / "v"))
    parts = [p.read_text() for p in (tmp_path / "v").iterdir() if p.suffix == ".csv"]
    header = "Act Title,Page URL,Link Type,Viewer URL\n"
    assert all(p.startswith(header) for p in parts) and "".join(p[len(header) :] for p in parts) == '"a ""q"", b",p,Not Found,N/A\n'
    assert not sinks.write_log(rows.limit(0), sinks.VIEW_HEADER, str(tmp_path / "none")) and not (tmp_path / "none").exists()
    docs = spark.createDataFrame([("s1", "ಕ", None), ("s2", "b", "e")], "file_stem string, title string, error string")
    assert sinks.write_documents(docs, str(tmp_path / "d")).count() == 2
    assert json.loads((tmp_path / "d" / "s1_extracted.json").read_text()) == {"title": "ಕ", "error": None}
    sinks.write_summary(spark.createDataFrame([(2, 0)], "total_files int, failed int"), str(tmp_path))
    assert json.loads((tmp_path / "extraction_summary.json").read_text()) == {"total_files": 2, "failed": 0}


def test_download_isolates_errors_and_never_overwrites(spark, tmp_path):
    def make():
        def get(url):
            if "bad" in url:
                raise OSError("no")
            return url.encode()

        return get

    targets = spark.createDataFrame([("x.pdf", "u1"), ("x.pdf", "u2"), ("y.pdf", "bad")], "saved_filename string, source_url string")
    got = sinks.download(targets, str(tmp_path / "f"), make).collect()
    assert sorted((r.status, r.n_bytes) for r in got) == [("failed", 0), ("success", 2), ("success", 2)]
    names = sorted(os.listdir(tmp_path / "f"))
    assert len(names) == 2 and all(n.startswith("x_") and n.endswith(".pdf") for n in names)


def test_fetch_and_extract(spark):
    def make():
        def get(url):
            if url == "bad":
                raise ValueError(url)
            return b"<html>"

        return get

    got = {r.url: (r.body, r.error) for r in fetch.fetch(spark.createDataFrame([("ok",), ("bad",)], "url string"), make).collect()}
    assert bytes(got["ok"][0]) == b"<html>" and got["bad"] == (None, "ValueError: bad")
    rows = spark.createDataFrame([(1, "p\n\nDocument content:\nTitle\nbody")], "doc_id int, prompt string")
    r = extract.extract(rows).first()
    assert json.loads(r.response_text)["document_info"]["title"] == "Title" and r.call_error is None


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (folder / "b.c.pdf").write_bytes(b"<!DOCTYPE html>")
    (folder / "sub" / "z.pdf").write_bytes(b"%PDF-")
    got = {r.file_stem: r.is_pdf for r in files.inventory(files.scan(spark, str(folder))).collect()}
    assert got == {"a": True, "b.c": False}
    read = files.texts(files.scan(spark, str(folder)), lambda b: b.decode() if b[:1] == b"%" else 1 / 0)
    assert {(r.text, r.error is None) for r in read.collect()} == {("%PDF-1.4 x", True), ("", False)}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.ingest(ingest.new_files(spark, str(folder)), out, state).awaitTermination(60)
    (folder / "n.pdf").write_bytes(b"%PDF-2")
    ingest.ingest(ingest.new_files(spark, str(folder)), out, state).awaitTermination(60)
    assert sorted(r.file_name for r in spark.read.parquet(out).collect()) == ["a.pdf", "b.c.pdf", "n.pdf"]


def test_windows(spark, small):
    log = spark.read.parquet(f"{small}/download_log.parquet")
    assert ingest.downloads_by_window(log).agg(F.sum("n_rows")).first()[0] == log.filter("logged_at is not null").count()


def test_pipeline_routes_and_isolates(spark):
    from quillspark.operators import pipeline

    rows = [(1, "Title\nbody", False), (2, "", False), (3, None, False), (4, "a. " * 30 + "\n\n" + "b. " * 30, False), (5, "x" * 120, False), (6, "file", True), (7, "bad", False)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id int, text string, direct boolean, record string")
    settings = pipeline.Settings(max_chars=100)
    calls = [(r.doc_id, r.method, r.n_chunks) for r in pipeline.route(docs, settings, "direct").orderBy("doc_id", "chunk_no").collect()]
    assert calls == [(1, "text_extraction", 1), (2, "empty", 1), (3, "empty", 1), (4, "chunk_1", 2), (4, "chunk_2", 2), (5, "text_truncated", 1), (6, "direct_upload", 1), (7, "text_extraction", 1)]

    def make():
        offline = extract.offline_model()

        def reply(prompt):
            if prompt.endswith("bad"):
                raise RuntimeError("down")
            return "```json\n" + offline(prompt) + "\n```"

        return reply

    got = {r.doc_id: r for r in pipeline.run(docs, settings, make, "direct").collect()}
    assert got[1].document_info.title == "Title" and got[1].error is None and got[1].method_resolved == "text_extraction"
    assert got[2].error == "no text" and got[7].error == "RuntimeError: down"
    assert got[4].method_resolved == "multi_chunk" and got[4].total_chunks == 2
    assert got[5].full_text_content.endswith("DOCUMENT CONTINUES]")
    suspect = spark.createDataFrame([("http://h/a.pdf", None), ("http://h/a", "text/html"), (None, "application/pdf")], "u string, c string")
    assert [r[0] for r in suspect.select(pipeline.is_suspect(F.col("u"), F.col("c"))).collect()] == [False, True, False]
