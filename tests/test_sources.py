import pytest

from tarnfield.plugins import HashEncoder
from tarnfield.settings import Settings
from tarnfield.sources import cache


def test_cache_and_fetch(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.html").write_text("kept")
    (tmp_path / "b/empty.html").write_text("")
    have = cache.cached(spark, str(tmp_path))
    assert [tuple(r) for r in have.collect()] == [("b/x.html", "kept")]
    paths = spark.createDataFrame([("b/x.html",), ("b/y.html",), ("b/none.html",)], "path string")

    def fetch(path):
        return (404, b"") if "none" in path else (200, b"new")

    log = {r["path"]: r for r in cache.fetched(cache.to_fetch(paths, have), fetch, 2, 0).collect()}
    assert set(log) == {"b/y.html", "b/none.html"} and log["b/y.html"]["ok"] and log["b/none.html"]["error"] == "HTTP 404"
    got = {r["path"]: r["html"] for r in cache.read_through(paths, have, fetch).collect()}
    assert got == {"b/x.html": "kept", "b/y.html": "new"}


def test_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert cache.read_table(spark, folder, "t", "x int").count() == 0
    cache.write_tables(folder, t=spark.range(3).selectExpr("cast(id as int) x"))
    assert cache.read_table(spark, folder, "t", "x int").count() == 3


@pytest.mark.parametrize(("url", "ok"), [("https://h.com/a/b", True), ("https://h.com/ab", False), ("https://h.com.evil/a/b", False), ("file:///a/b", False), ("https://h.com/a/../c", False)])
def test_live_guard(url, ok):
    assert cache.is_below(url, "https://h.com/a") is ok


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "s.yaml").write_text("k_final: 4\nchunk_size: 10\n")
    monkeypatch.setenv("TARNFIELD_CHUNK_SIZE", "20")
    found = Settings.load(str(tmp_path / "s.yaml"), k1=2.0)
    assert (found.k_final, found.chunk_size, found.k1) == (4, 20, 2.0)
    with pytest.raises(ValueError, match="unknown"):
        Settings.load(nothing=1)


def test_encoder():
    assert abs((HashEncoder()(["a b", ""])[0] ** 2).sum() - 1) < 1e-6


def test_incremental_index(spark, tmp_path):
    from tarnfield.streaming.incremental import follow_postings

    spark.createDataFrame([(1, "a b a")], "id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    follow_postings(stream, "id", "text", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["term"], r["tf"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 2), ("b", 1)}


def test_http_fetch():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if "there" in self.path else 404)
            self.end_headers()
            self.wfile.write(b"body")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/help"
    fetch = cache.http_fetch(base)
    assert fetch("there.html") == (200, b"body") and fetch("no.html") == (404, b"") and fetch(base + "/there") == (200, b"body")
    server.shutdown()


def test_images(spark):
    figures = spark.createDataFrame([("img/a b.png",), ("img/a b.png",), ("img/c.png",), ("x/c.png",), ("img/have.png",), ("",)], "src string")
    have = spark.createDataFrame([("cache/have.png",)], "path string")
    log = {r["name"]: (r["path"], r["ok"]) for r in cache.images(figures, have, lambda p: (200, b"png"), tasks=2, pause=0).collect()}
    assert log == {"a b.png": ("img/a%20b.png", True), "c.png": ("img/c.png", True)}


def test_knowledge_and_menus(spark, tmp_path):
    import json

    from tarnfield.operators import pages, toc

    link = '<a class="WebWorks_TOC_Link" href="b/{0}.shtml">{1}</a>'
    page = f'<div id="toc:1"><ul><li>{link.format("y", "Launch Y")}</li><li>{link.format("x", "X")}</li></ul></div><a id="topic:0:k" href="b/z.shtml">Zed, Zet</a>'
    index, names, lines = toc.master_toc(spark.createDataFrame([(page,)], "html string"), "b")
    assert names.count() == 2 and lines.count() == 2
    cache.save_knowledge(str(tmp_path), index, names=names)
    (part,) = tmp_path.glob("pages/part-*.json")
    rows = [json.loads(x) for x in part.read_text().splitlines()]
    assert [(r["path"], r["title"], r["page_type"]) for r in rows] == [("b/y.shtml", "Launch Y", "launch"), ("b/x.shtml", "X", "concept"), ("b/z.shtml", "Zed", "concept")]
    menu = "<table><caption>File Menu</caption><tr><td>Open</td><td>Opens</td></tr></table>"
    raw = spark.createDataFrame([(menu, "windows"), (None, "macos")], "html string, platform string")
    assert [r["platform"] for r in pages.menu_index(raw).collect()] == ["windows"]
    with pytest.raises(ValueError, match="windows"):
        pages.menu_index(raw.where("platform = 'macos'"))
