"""Runs over folders, live fetches from a server of this machine, remote files, settings."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.operators import pipeline, report
from quillspark.sources import config, extract, fetch, remote, sinks


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path == "/gone":
                self.send_error(410)
                return
            self.send_response(200)
            self.send_header("Set-Cookie", "seen=1")
            self.end_headers()
            self.wfile.write(f"{self.path} {self.headers.get('Cookie', '-')} {self.headers['User-Agent']}".encode())

        def log_message(self, *_):
            pass

    own = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_live_fetch(spark, server):
    urls = spark.createDataFrame([(f"{server}/a",), (f"{server}/b",), (f"{server}/gone",)], "url string").coalesce(1)
    got = {r.url.rpartition("/")[2]: r for r in fetch.fetch(urls, fetch.http_fetcher).collect()}
    assert bytes(got["a"].body).startswith(b"/a - Mozilla") and bytes(got["b"].body).startswith(b"/b seen=1")  # one session a partition
    assert got["gone"].body is None and "410" in got["gone"].error
    assert fetch.listing(f"{server}/list", fetch.http_fetcher).startswith("/list")
    with pytest.raises(RuntimeError, match="could not be read"):
        fetch.listing(f"{server}/gone", fetch.http_fetcher)


def test_download_counters(spark, server, tmp_path):
    targets = spark.createDataFrame([("x.pdf", f"{server}/1"), ("y.pdf", f"{server}/gone")], "saved_filename string, source_url string")
    got = report.download_summary(sinks.download(targets, str(tmp_path), fetch.http_fetcher)).first()
    assert (got.total, got.successful, got.failed) == (2, 1, 1) and got.n_bytes == len((tmp_path / "x.pdf").read_bytes())


def test_remote_files(spark, tmp_path):
    log = str(tmp_path / "log")

    class Store(remote.OfflineStore):
        def put(self, name, content):
            if name == "bad":
                raise OSError("no")
            return super().put(name, content)

        def state(self, handle):
            return remote.WAITING if handle.endswith("slow") else super().state(handle)

        def delete(self, handle):
            super().delete(handle)
            with open(log, "a") as f:
                f.write(handle + "\n")

    rows = [("d/a.pdf", b"%PDF-1"), ("d/b.pdf", b"<html>"), ("d/slow", b"%PDF-"), ("bad", b""), ("n", None)]
    files = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    got = {r.path: r for r in remote.upload(files, Store, lambda s, h: h.upper(), delay=0.0, most_looks=5).collect()}
    assert (got["d/a.pdf"].state, got["d/a.pdf"].result, got["d/a.pdf"].error) == ("ACTIVE", "FILES/A.PDF", None)
    assert got["d/b.pdf"].error == "file processing failed: FAILED" and got["d/slow"].error == "file processing failed: PROCESSING"
    assert got["bad"].error == "OSError: no" and got["n"].error is not None
    assert sorted(open(log).read().split()) == ["files/a.pdf", "files/b.pdf", "files/n", "files/slow"]  # cleaned up whatever happened


def test_settings(tmp_path):
    path = str(tmp_path / ".env")
    assert not config.write_template(path) and config.write_template(path)
    assert config.settings(path, environ={"MODEL_API_KEY": "k"}) == {"MODEL_API_KEY": "k"}
    (tmp_path / ".env").write_text("# c\n\nMODEL_API_KEY = 'own'\n")
    assert config.settings(path, environ={}) == {"MODEL_API_KEY": "own"}
    with pytest.raises(RuntimeError, match="OTHER"):
        config.settings(path, ("OTHER",), {})


def counting(log, fail=lambda prompt: False):
    def make():
        offline = extract.offline_model()

        def reply(prompt):
            with open(log, "a") as f:
                f.write("x")
            if fail(prompt):
                raise RuntimeError("down")
            return offline(prompt)

        return reply

    return make


def test_each_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "calls"
    docs = spark.createDataFrame([(i, f"Title {i}\nbody") for i in range(20)] + [(90, ""), (91, "a. " * 30 + "\n\n" + "b. " * 30)], "doc_id int, text string")
    got = {r.doc_id: r for r in pipeline.run(docs, pipeline.Settings(max_chars=100), counting(log)).collect()}
    assert len(log.read_text()) == 22 and got[90].error == "no text" and got[90].document_info is None and got[91].total_chunks == 2
    assert got[3]._metadata.processing_method == "text_extraction" and got[91]._metadata is None


def test_failed_direct_calls_are_retried_by_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "DIRECT one", True), (2, "", True), (3, "plain", False)], "doc_id int, text string, direct boolean")
    down = lambda p: "DIRECT" in p and not p.endswith("DIRECT one\n") and seen(p)
    calls = tmp_path / "calls"

    def seen(_):
        return len(calls.read_text()) <= 3  # the first round fails for direct files

    got = {r.doc_id: r for r in pipeline.run(docs.coalesce(1), pipeline.Settings(max_chars=100), counting(calls, down), "direct").collect()}
    assert got[1].method_resolved == "text_extraction" and got[1].error is None and got[3].method_resolved == "text_extraction"


def test_folder_run(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for name, text in (("a", "Alpha\nx"), ("b", "Beta\ny"), ("c", "")):
        (folder / f"{name}.pdf").write_bytes(b"%PDF-" + text.encode())
    out.mkdir()
    (out / "b_extracted.json").mkdir()  # cannot be replaced by a file
    settings = pipeline.Settings(output_folder=str(out))
    got = pipeline.run_folder(spark, str(folder), settings, reader=lambda b: b[5:].decode()).first()
    assert (got.total_files, got.processed_successfully, got.failed) == (3, 2, 1)
    results = {r.file: r for r in got.results}
    assert results["a.pdf"].output == "a_extracted.json" and results["b.pdf"].status == "failed" and results["b.pdf"].error and results["b.pdf"].output is None
    own = json.loads((out / "a_extracted.json").read_text())
    assert own["document_info"]["title"] == "Alpha" and own["source_file"] == "a.pdf" and own["file_size_bytes"] == 12 and own["extraction_timestamp"]
    assert json.loads((out / "c_extracted.json").read_text())["error"] == "no text"
    summary = json.loads((out / "extraction_summary.json").read_text())
    assert summary["total_files"] == 3 and len(summary["results"]) == 3 and summary["processing_started"] <= summary["processing_completed"]
    empty = tmp_path / "none"
    empty.mkdir()
    assert pipeline.run_folder(spark, str(empty), settings).first().error == "No PDF files found"


def test_statuses(spark):
    rows = spark.createDataFrame([("a.pdf", None, "m", None, ("s",)), ("b.pdf", None, "m", "bad", (None,)), (None, "c.pdf", None, None, (None,))], "source_file string, file string, processing_method string, error string, main_content struct<summary:string>")
    got = report.statuses(rows, (), F.when(F.col("source_file") == "b.pdf", F.lit("lost"))).collect()
    assert [(r.status, r.output, r.method, r.error) for r in got] == [("success", "a_extracted.json", "m", None), ("failed", None, None, "lost"), ("success", "c_extracted.json", "unknown", None)]
