"""From raw pages, HTML and wiki text to cleaned segments with their sections."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Wiki sections that hold no content.
DROPPED_SECTIONS = ["see also", "references", "notes", "external links", "further reading", "sources", "bibliography", "citations", "works cited", "footnotes"]


def repeated_lines(blocks: DataFrame, shorter_than: int = 100, pages: int = 4, share: float = 0.4) -> DataFrame:
    """(doc_id, key) of running headers and footers in blocks (doc_id, page, block_no, text).

    A key counts once a page, for short blocks only; it repeats on 40 % of the pages of a document of four pages or more.
    """
    trimmed = F.trim("text")
    keys = blocks.where(F.length(trimmed) < shorter_than).select("doc_id", "page", T.line_key(F.col("text")).alias("key")).distinct()
    sizes = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    counts = keys.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    return counts.join(sizes, "doc_id").where((F.col("pages") >= pages) & (F.col("n") >= share * F.col("pages"))).select("doc_id", "key")


def page_places(blocks: DataFrame) -> DataFrame:
    """blocks with the index of their page (_idx, from 0) among all of the document's pages, and how many these are (_pages)."""
    own = Window.partitionBy("doc_id")
    return blocks.withColumn("_idx", F.dense_rank().over(own.orderBy("page")) - 1).withColumn("_pages", F.max("_idx").over(own) + 1)


def refs_cutoff(blocks: DataFrame) -> DataFrame:
    """blocks before the first one, from page index max(2, a third of the pages) on, that starts the references.

    Pages are counted as page_places found them, where blocks have its columns; so a page of which no block is left still
    counts. A page without any block isn't known: give it one with an empty text.
    """
    placed = blocks if "_idx" in blocks.columns else page_places(blocks)
    late = F.col("_idx") >= F.greatest(F.lit(2), F.floor(F.col("_pages") / 3))
    place = F.struct("page", "block_no")
    cut = F.min(F.when(late & T.is_reference_start(F.trim("text")), place)).over(Window.partitionBy("doc_id"))
    kept = placed.withColumn("_cut", cut).where(F.col("_cut").isNull() | (place < F.col("_cut")))
    return kept.drop("_cut", "_idx", "_pages")


def page_segments(blocks: DataFrame) -> DataFrame:
    """(doc_id, seg_no, page, section, text): kept blocks joined by page and section.

    Drops empty and bare-number blocks and repeated lines, stops at the references; a heading opens a segment, stays in
    its text, and names the section until the next one. Texts are dealt by document once; a document's repeated lines, of
    which there are at most two and a half times as many as a page has blocks, come to it in an array.
    """
    keys = repeated_lines(blocks).groupBy("doc_id").agg(F.collect_list("key").alias("_repeated"))
    # Headings are found before texts are dealt out: rows that come back from Python would be dealt out again.
    named = blocks.withColumn("text", T.trimmed(F.col("text"))).withColumn("_h", T.heading_of(T.clean_text(F.col("text"))))
    clean = page_places(named).join(keys, "doc_id", "left")
    repeated = F.coalesce(F.array_contains("_repeated", T.line_key(F.col("text"))), F.lit(False))
    clean = refs_cutoff(clean.where((F.col("text") != "") & ~T.is_bare_number(F.col("text")) & ~repeated).drop("_repeated"))
    order = Window.partitionBy("doc_id").orderBy("page", "block_no")
    marked = clean.withColumn("section", F.last("_h", ignorenulls=True).over(order)).withColumn("_run", F.count("_h").over(order))
    joined = marked.groupBy("doc_id", "page", "_run").agg(
        F.first("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), "\n\n").alias("text")
    )
    number = Window.partitionBy("doc_id").orderBy("page", "_run")
    numbered = joined.withColumn("seg_no", F.row_number().over(number) - 1)
    return numbered.select("doc_id", "seg_no", "page", "section", T.clean_text(F.col("text")).alias("text"))


def wiki_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, seg_no, section, text) of wiki texts (doc_id, text), split at lines == Title == of levels 2 to 4.

    What comes before is the Introduction. Everything under a dropped section of level 2 goes, and so do empty parts. A
    deeper section is named top > title, or title where no section of level 2 came before.
    """
    mark = r"(?m)^(={2,4})[ \t]*(\S(?:.*?\S)?)[ \t]*\1[ \t]*$"
    text = F.concat(F.col("text"), F.lit("\n"))
    gaps, levels, titles = F.split(text, mark, -1), F.regexp_extract_all(text, F.lit(mark), F.lit(1)), F.regexp_extract_all(text, F.lit(mark), F.lit(2))
    parts = F.arrays_zip(F.concat(F.array(F.lit("")), levels).alias("level"), F.concat(F.array(F.lit("Introduction")), titles).alias("title"), gaps.alias("body"))
    rows = pages.select("doc_id", F.posexplode(parts).alias("seg_no", "p")).select("doc_id", "seg_no", F.length("p.level").alias("level"), "p.title", "p.body")
    order = Window.partitionBy("doc_id").orderBy("seg_no")
    rows = rows.withColumn("top", F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(order))
    section = F.when(F.col("level").isin(0, 2) | F.col("top").isNull(), F.col("title")).otherwise(F.concat("top", F.lit(" > "), "title"))
    rows = rows.where(~F.coalesce(F.lower("top").isin(DROPPED_SECTIONS), F.lit(False)))
    return rows.select("doc_id", "seg_no", section.alias("section"), T.clean_text(F.col("body")).alias("text")).where("text != ''")


class _Blocks(HTMLParser):
    """Block elements in document order: tag, text, characters inside links, text of bold children."""

    SKIPPED = frozenset(("script", "style", "nav", "header", "footer", "noscript"))
    HELD = frozenset(("h1", "h2", "h3", "h4", "p", "pre", "blockquote", "li", "td"))
    OUTER = frozenset(("p", "li", "blockquote", "td"))
    VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: list[list] = []  # [tag, depth, text, link characters, bold text]
        self.done: list[list] = []
        self.all: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        if tag == "p":  # a paragraph ends where the next one starts
            self._close_to("p", ("li", "blockquote", "td", "div", "body"))
        elif tag in ("li", "td"):
            self._close_to(tag, ("ul", "ol", "table", "tr", "body"))
        self.stack.append(tag)
        if tag in self.HELD and not any(b[0] in self.OUTER for b in self.open) and not self.SKIPPED & set(self.stack):
            block = [tag, len(self.stack), [], 0, []]
            self.open.append(block)
            self.done.append(block)

    def _close_to(self, tag, stop):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] == tag:
                self._drop(i)
                return
            if self.stack[i] in stop:
                return

    def _drop(self, i):
        del self.stack[i:]
        self.open = [b for b in self.open if b[1] <= len(self.stack)]

    def handle_endtag(self, tag):
        if tag in self.stack:
            self._drop(len(self.stack) - 1 - self.stack[::-1].index(tag))

    def handle_data(self, data):
        if self.SKIPPED & set(self.stack):
            return
        self.all.append(data)
        for block in self.open:
            block[2].append(data)
            inner = self.stack[block[1] :]
            if "a" in inner:
                block[3] += len(data)
            if inner[:1] in (["b"], ["strong"]):
                block[4].append(data)


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, seq, tag, text, link_chars, bold, all_chars) of HTML (page_id, html): the parser's part, without rules."""

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parser = _Blocks()
                parser.feed(html.as_py() or "")
                parser.close()
                size = len(" ".join("".join(parser.all).split()))
                for seq, (tag, _, text, links, bold) in enumerate(parser.done):
                    rows.append((page_id, seq, tag, " ".join("".join(text).split()), links, "".join(bold).strip(), size))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "seq", "tag", "text", "link_chars", "bold", "all_chars"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, seq int, tag string, text string, link_chars int, bold string, all_chars int")


def html_sections(blocks: DataFrame) -> DataFrame:
    """(page_id, seg_no, section, text) of html_blocks: headings and short bold paragraphs name sections, others are text.

    Blocks under 40 characters or with links over half their text are navigation.
    """
    size = F.length("text")
    heading = F.col("tag").isin("h1", "h2", "h3", "h4") | ((size <= 80) & (F.col("bold") == F.col("text")) & ~F.col("text").rlike("[0-9]"))
    order = Window.partitionBy("page_id").orderBy("seq")
    rows = blocks.where(size > 0).withColumn("_h", F.when(heading, F.substring("text", 1, 80)))
    rows = rows.withColumn("section", F.last("_h", ignorenulls=True).over(order)).withColumn("_run", F.count("_h").over(order))
    rows = rows.where(F.col("_h").isNull() & (size >= 40) & (F.col("link_chars") < 0.5 * size))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda b: b["text"]), "\n\n")
    joined = rows.groupBy("page_id", "_run").agg(F.first("section").alias("section"), text.alias("text"))
    return joined.select("page_id", F.col("_run").cast("int").alias("seg_no"), "section", T.clean_text(F.col("text")).alias("text"))


class _Tree(HTMLParser):
    """The elements of a page with what each holds: the worth of its own and its descendants' text.

    Text that lies directly in an element, up to the next element that isn't inline, is a piece. It is worth its length,
    less twice what of it lies in links, less PIECE_COST; so long text with few links counts for an element, menus and
    bylines against it.
    """

    INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr br img".split())
    PIECE_COST = 25

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.names, self.parents, self.worth = ["html"], [-1], [0]
        self.stack, self.inline, self.skipped = [0], [], 0
        self.text: list[str] = []
        self.links = 0
        self.pieces: list[tuple[int, str]] = []  # (element, text) in document order

    def _piece(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.pieces.append((self.stack[-1], text))
            self.worth[self.stack[-1]] += len(text) - 2 * min(self.links, len(text)) - self.PIECE_COST
        self.text, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _Blocks.SKIPPED:
            self.skipped += 1
        if self.skipped:
            return
        if tag in self.INLINE:
            if tag == "br":
                self.text.append(" ")
            elif tag not in _Blocks.VOID:
                self.inline.append(tag)
            return
        self._piece()
        self.inline = []
        if tag in _Blocks.VOID:
            return
        if tag in ("p", "li", "td", "tr") and self.names[self.stack[-1]] == tag:  # ends where the next one starts
            self.stack.pop()
        self.names.append(tag)
        self.parents.append(self.stack[-1])
        self.worth.append(0)
        self.stack.append(len(self.names) - 1)

    def handle_endtag(self, tag):
        if tag in _Blocks.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
            return
        if self.skipped or tag in _Blocks.VOID:
            return
        if tag in self.INLINE:
            if tag in self.inline:
                del self.inline[len(self.inline) - 1 - self.inline[::-1].index(tag) :]
            return
        self._piece()
        self.inline = []
        for i in range(len(self.stack) - 1, 0, -1):
            if self.names[self.stack[i]] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)
            self.links += len("".join(data.split())) if "a" in self.inline else 0

    def main(self) -> list[str]:
        """The pieces of the element whose text is worth most, descendants included; the innermost of equal ones."""
        self._piece()
        total = list(self.worth)
        for n in range(len(total) - 1, 0, -1):  # children come after their parents
            total[self.parents[n]] += total[n]
        best = max(range(len(total)), key=lambda n: (total[n], n))
        inside = [False] * len(total)
        for n in range(len(total)):
            inside[n] = n == best or (n > 0 and inside[self.parents[n]])
        return [text for n, text in self.pieces if inside[n]] if total[best] > 0 else []


def main_content(html: str | None) -> str:
    """The main text of a page, its pieces parted by empty lines; empty where no element holds more text than trimmings."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return "\n\n".join(tree.main())


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, whole): the main content of HTML pages (page_id, html)."""

    def run(batches):
        for batch in batches:
            texts = [main_content(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "whole"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, whole string")


def html_with_fallback(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """html_sections of blocks, but the page's main content as one segment, without a section, where they hold under half of it.

    The blocks are read once; each page's segments travel in an array to the page that may need the other text.
    """
    found = html_sections(blocks)
    own = found.groupBy("page_id").agg(F.collect_list(F.struct("seg_no", "section", "text")).alias("segs"), F.sum(F.length("text")).alias("kept"))
    rows = main_texts(pages).select("page_id", T.clean_text(F.col("whole")).alias("whole")).join(own, "page_id", "left")
    poor = F.coalesce("kept", F.lit(0)) < 0.5 * F.length("whole")
    one = F.array(F.struct(F.lit(0).alias("seg_no"), F.lit(None).cast("string").alias("section"), F.col("whole").alias("text")))
    return rows.select("page_id", F.explode(F.when(poor, one).otherwise(F.col("segs"))).alias("s")).select("page_id", "s.seg_no", "s.section", "s.text").where("text != ''")
