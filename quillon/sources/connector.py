"""Corpus documents by a Spark data source: a partition for each document, a row for each, failures as a status.

    spark.dataSource.register(CorpusFiles)
    spark.read.format("corpus_files").option("documents", json_rows).load()

Documents are JSON rows with id, url, format (pdf, html, wikipedia) and perhaps pages ("3-9"). A client fetches; make a
subclass whose client() gives another one. A document that can't be fetched, is missing, or isn't what its format says
has no content, and its status and message say why; the others aren't touched by it.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.parse import unquote, urlencode, urlparse
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

ATTEMPTS, PAUSE = 4, 0.5
EXTENSIONS = {"pdf": "pdf", "html": "html", "wikipedia": "json"}
WIKI_API = "https://en.wikipedia.org/w/api.php"


@dataclass
class Reply:
    """What a client answers: a status code, headers with lower-case names, a body."""

    code: int
    headers: dict[str, str]
    body: bytes


def http_client(url: str) -> Reply:
    """One GET request, redirects followed."""
    try:
        with urlopen(Request(url, headers={"User-Agent": "quillon corpus reader"}), timeout=60) as answer:  # noqa: S310
            return Reply(answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read())
    except HTTPError as error:
        return Reply(error.code, {k.lower(): v for k, v in error.headers.items()}, b"")


class Failed(Exception):
    """A document's status, and what there is to say about it."""

    def __init__(self, status: str, message: str) -> None:
        super().__init__(message)
        self.status, self.message = status, message


def fetched(client: Callable[[str], Reply], url: str, sleep: Callable[[float], None], attempts: int = ATTEMPTS) -> tuple[bytes, int]:
    """The body and the number of requests; a reply 429 is waited out as it asks, or five seconds for each attempt so far."""
    for attempt in range(attempts):
        reply = client(url)
        if reply.code != 429:
            break
        if attempt + 1 < attempts:
            try:
                wait = float(reply.headers.get("retry-after", ""))
            except ValueError:  # absent, or a date
                wait = 5.0 * (attempt + 1)
            sleep(wait)
    if reply.code != 200:
        raise Failed(f"http_{reply.code}", f"{url} answered {reply.code}")
    return reply.body, attempt + 1


def wiki_page(client: Callable[[str], Reply], url: str, sleep: Callable[[float], None]) -> tuple[bytes, int, int]:
    """A wiki page's title, plain text and revision as JSON, the revision, and the number of requests."""
    title = unquote(urlparse(url).path.rsplit("/", 1)[-1])
    asked = {"action": "query", "format": "json", "formatversion": 2, "redirects": 1, "prop": "extracts|revisions", "explaintext": 1, "rvprop": "ids|timestamp", "titles": title}
    body, attempts = fetched(client, f"{WIKI_API}?{urlencode(asked)}", sleep)
    try:
        page = json.loads(body)["query"]["pages"][0]
    except (ValueError, KeyError, IndexError):
        raise Failed("bad_reply", f"no page in the reply for {title}") from None
    if "missing" in page or not page.get("extract"):
        raise Failed("missing", f"no such page: {title}")
    revision = page["revisions"][0]
    held = {"title": page["title"], "text": page["extract"], "revision_id": revision["revid"], "revision_timestamp": revision["timestamp"]}
    return json.dumps(held, ensure_ascii=False).encode(), revision["revid"], attempts


@dataclass
class OneDocument(InputPartition):
    document: dict

    def __init__(self, document: dict) -> None:
        super().__init__(None)
        self.document = document


class CorpusFiles(DataSource):
    """Options: documents (JSON rows), only (ids, comma-joined), folder (files that are there are taken from it), force."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return "id string, url string, format string, status string, message string, bytes long, revision long, attempts int, content binary"

    def client(self) -> Callable[[str], Reply]:
        return http_client

    def sleep(self) -> Callable[[float], None]:
        return time.sleep

    def documents(self) -> list[dict]:
        rows = json.loads(self.options.get("documents", "[]"))
        only = [x for x in self.options.get("only", "").split(",") if x]
        return [r for r in rows if not only or r["id"] in only]

    def reader(self, schema) -> DataSourceReader:
        return _Files(self)


class _Files(DataSourceReader):
    def __init__(self, source: CorpusFiles) -> None:
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [OneDocument(d) for d in self.source.documents()]

    def read(self, partition: OneDocument | None) -> Iterator[tuple]:
        if partition is None:  # no documents
            return
        doc = partition.document
        try:
            content, revision, attempts = self._content(doc)
            yield doc["id"], doc.get("url"), doc["format"], "ok", None, len(content), revision, attempts, content
        except Failed as error:
            yield doc["id"], doc.get("url"), doc.get("format"), error.status, error.message, None, None, None, None
        except Exception as error:  # one document's trouble, whatever it is, isn't the others'
            yield doc["id"], doc.get("url"), doc.get("format"), "error", f"{type(error).__name__}: {error}", None, None, None, None

    def _content(self, doc: dict) -> tuple[bytes, int | None, int]:
        if doc.get("format") not in EXTENSIONS:
            raise Failed("unknown_format", f"no reader for {doc.get('format')!r}")
        folder, force = self.source.options.get("folder"), self.source.options.get("force", "false") == "true"
        at = folder and os.path.join(folder, f"{doc['id']}.{EXTENSIONS[doc['format']]}")
        if at and not force and os.path.exists(at):
            with open(at, "rb") as f:
                content, revision, attempts = f.read(), None, 0
            if doc["format"] == "wikipedia":
                revision = json.loads(content).get("revision_id")
        elif not doc.get("url"):
            raise Failed("missing", "no file and no address")
        elif doc["format"] == "wikipedia":
            content, revision, attempts = wiki_page(self.source.client(), doc["url"], self.source.sleep())
            self.source.sleep()(PAUSE)
        else:
            (content, attempts), revision = fetched(self.source.client(), doc["url"], self.source.sleep()), None
            self.source.sleep()(PAUSE)
        if doc["format"] == "pdf" and not content.startswith(b"%PDF"):
            raise Failed("bad_magic", f"not a PDF: begins with {content[:8]!r}")
        return content, revision, attempts


def page_range(pages: str | None) -> tuple[int, int | None]:
    """First and last page of "3-9", from 1; all pages for none."""
    if not pages:
        return 1, None
    first, last = map(int, pages.split("-"))
    return first, last


class PageBlocks(CorpusFiles):
    """(id, page, block_no, text, status, message) of the text blocks of PDF documents, by a subclass' extract().

    Only the document's own pages are read, and of these only those that a filter on page asks for. A document that
    can't be read is one row with a status.
    """

    @classmethod
    def name(cls) -> str:
        return "page_blocks"

    def schema(self) -> str:
        return "id string, page int, block_no int, text string, status string, message string"

    def extract(self, content: bytes, first: int, last: int | None) -> Iterator[tuple[int, int, str]]:
        """(page, block_no, text) of the pages from first to last, both included, or to the end."""
        raise Failed("no_extractor", "a subclass has to read PDF files")

    def reader(self, schema) -> DataSourceReader:
        return _Blocks(self)


class _Blocks(_Files):
    def __init__(self, source: PageBlocks) -> None:
        super().__init__(source)
        self.first, self.last = 1, None

    def pushFilters(self, filters: list[Filter]):
        """Bounds on page are taken over by the reader; Spark still checks the other filters."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("page",) or (value is None and not isinstance(f, In)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                top = value - isinstance(f, LessThan)
                self.last = top if self.last is None else min(self.last, top)
            yield f

    def read(self, partition: OneDocument | None) -> Iterator[tuple]:
        if partition is None:  # no documents
            return
        doc = partition.document
        first, last = page_range(doc.get("pages"))
        bounds = [x for x in (last, self.last) if x is not None]
        first, last = max(first, self.first), min(bounds) if bounds else None
        try:
            if last is not None and first > last:
                return
            content = self._content(doc)[0]
            for page, block, text in self.source.extract(content, first, last):
                yield doc["id"], page, block, text, "ok", None
        except Failed as error:
            yield doc["id"], None, None, None, error.status, error.message
        except Exception as error:
            yield doc["id"], None, None, None, "error", f"{type(error).__name__}: {error}"
