"""The corpus source with a client that needs no network."""

import json

from quillon.sources import connector as K


def fakes():
    """Sources whose client and extractor are made here, so that tasks get them by value."""
    from collections.abc import Iterator

    def wiki(**page):
        return K.Reply(200, {}, json.dumps({"query": {"pages": [page]}}).encode())

    def client():
        calls = {}

        def get(url):
            calls[url] = calls.get(url, 0) + 1
            if url.endswith("gone.pdf"):
                return K.Reply(404, {}, b"")
            if url.endswith("busy.html"):
                return K.Reply(429, {"retry-after": "0.5"}, b"") if calls[url] < 3 else K.Reply(200, {}, b"<p>at last</p>")
            if url.endswith("always.html"):
                return K.Reply(429, {}, b"")
            if url.endswith("broken.html"):
                raise OSError("reset")
            if "titles=Alan+Turing" in url:
                return wiki(title="Alan Turing", extract="Text.", revisions=[{"revid": 77, "timestamp": "2024"}])
            if "titles=" in url:
                return wiki(title="?", missing=True)
            return K.Reply(200, {}, b"%PDF-1.7 one|two|three|four|five" if url.endswith("good.pdf") else b"<html>")

        return get

    class Files(K.CorpusFiles):
        def client(self):
            return client()

        def sleep(self):
            return lambda s: None

    class Blocks(K.PageBlocks):
        def client(self):
            return client()

        def sleep(self):
            return lambda s: None

        def extract(self, content: bytes, first, last) -> Iterator:
            assert first >= 2 or last is None or last <= 4
            for n, text in enumerate(content[9:].decode().split("|"), 1):
                if n >= first and (last is None or n <= last):
                    yield n, 0, text

    return Files, Blocks


DOCS = [
    {"id": "good", "url": "http://x/good.pdf", "format": "pdf", "pages": "2-4"}, {"id": "fake", "url": "http://x/fake.pdf", "format": "pdf"},
    {"id": "gone", "url": "http://x/gone.pdf", "format": "pdf"}, {"id": "busy", "url": "http://x/busy.html", "format": "html"},
    {"id": "always", "url": "http://x/always.html", "format": "html"}, {"id": "broken", "url": "http://x/broken.html", "format": "html"},
    {"id": "turing", "url": "https://en.wikipedia.org/wiki/Alan%20Turing", "format": "wikipedia"}, {"id": "nobody", "url": "https://en.wikipedia.org/wiki/Nobody", "format": "wikipedia"},
    {"id": "odd", "url": "http://x/odd", "format": "epub"}, {"id": "local", "format": "html"},
]


def test_a_row_for_each_document_with_its_status(spark, tmp_path):
    files, _ = fakes()
    spark.dataSource.register(files)
    read = lambda **o: {r["id"]: r for r in spark.read.format("corpus_files").options(documents=json.dumps(DOCS), **o).load().collect()}
    got = read()
    status = {i: r["status"] for i, r in got.items()}
    assert status == {"good": "ok", "fake": "bad_magic", "gone": "http_404", "busy": "ok", "always": "http_429", "broken": "error", "turing": "ok", "nobody": "missing", "odd": "unknown_format", "local": "missing"}
    assert got["busy"]["attempts"] == 3 and got["busy"]["bytes"] == 14 and bytes(got["busy"]["content"]) == b"<p>at last</p>"
    assert got["turing"]["revision"] == 77 and json.loads(bytes(got["turing"]["content"]))["text"] == "Text."
    assert all(r["content"] is None and r["message"] for r in got.values() if r["status"] != "ok")
    (tmp_path / "local.html").write_bytes(b"<p>kept</p>")
    (tmp_path / "busy.html").write_bytes(b"old")
    got = read(folder=str(tmp_path), only="local,busy")
    assert {i: (bytes(r["content"]), r["attempts"]) for i, r in got.items()} == {"local": (b"<p>kept</p>", 0), "busy": (b"old", 0)}
    assert read(folder=str(tmp_path), only="busy", force="true")["busy"]["attempts"] == 3
    assert spark.read.format("corpus_files").load().count() == 0


def test_a_partition_for_each_document(spark):
    files, _ = fakes()
    spark.dataSource.register(files)
    assert spark.read.format("corpus_files").option("documents", json.dumps(DOCS)).load().rdd.getNumPartitions() == len(DOCS)


def test_page_ranges_reach_the_reader(spark):
    _, blocks = fakes()
    spark.dataSource.register(blocks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = lambda: spark.read.format("page_blocks").option("documents", json.dumps(DOCS[:3])).load()
    assert sorted((r["id"], r["page"], r["text"], r["status"]) for r in read().where("id = 'good'").collect()) == [("good", 2, "two", "ok"), ("good", 3, "three", "ok"), ("good", 4, "four", "ok")]
    assert [r["text"] for r in read().where("page >= 3 and page < 4").collect()] == ["three"]
    assert {r["id"]: r["status"] for r in read().where("page is null").collect()} == {"fake": "bad_magic", "gone": "http_404"}
    assert K.page_range("3-9") == (3, 9) and K.page_range(None) == (1, None)


def test_waits():
    waited = []
    replies = iter([K.Reply(429, {}, b""), K.Reply(429, {"retry-after": "7"}, b""), K.Reply(429, {"retry-after": "Wed, 21 Oct"}, b""), K.Reply(200, {}, b"x")])
    assert K.fetched(lambda u: next(replies), "u", waited.append) == (b"x", 4) and waited == [5.0, 7.0, 15.0]
