"""Chunks of segments with exact offsets in the document's text."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.arrow import sliced

#: Where a text is cut, the coarsest place first.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")
_TOKENIZERS: dict = {}
_COUNTED = re.compile(r"\w{1,4}|[^\w\s]")


def pieces(text: str) -> list[str]:
    """A deterministic stand-in for a tokenizer: pieces of at most four letters, and signs."""
    return _COUNTED.findall(text)


def count_tokens(text: str) -> int:
    return len(pieces(text))


def vocabulary_length(path: str) -> Callable[[str], int]:
    """A token counter by a tokenizer's JSON file, read once a process: for chunk_docs(length=…)."""

    def length(text: str) -> int:
        if path not in _TOKENIZERS:
            from tokenizers import Tokenizer

            _TOKENIZERS[path] = Tokenizer.from_file(path)
        return len(_TOKENIZERS[path].encode(text, add_special_tokens=False).ids)

    return length


def full_texts(segments: DataFrame) -> DataFrame:
    """(doc_id, full_text): segments (doc_id, seg_no, text) in order, each followed by an empty line."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda s: F.concat(s["text"], F.lit("\n\n")))
    return segments.groupBy("doc_id").agg(F.array_join(parts, "").alias("full_text"))


def full_text_of_lines(text: Column) -> Column:
    """What full_texts gives for a text whose lines are its segments, in the row that holds it."""
    return F.concat(F.replace(text, F.lit("\n"), F.lit("\n\n")), F.lit("\n\n"))


def segment_offsets(segments: DataFrame) -> DataFrame:
    """segments with the 0-based start of each in its document's full text."""
    before = Window.partitionBy("doc_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("long"))


def _pieces(start: int, end: int, size: int, separators: tuple[str, ...], text: str, length: Callable[[int, int], int]):
    """(start, end) of pieces of text[start:end] of at most size tokens; separators stay at their piece's end."""
    if length(start, end) <= size or end - start <= 1:
        yield start, end
        return
    for i, mark in enumerate(separators):
        if mark and text.find(mark, start, end - len(mark)) >= 0:
            at = start
            while at < end:
                hit = text.find(mark, at, end)
                stop = end if hit < 0 else hit + len(mark)
                yield from _pieces(at, stop, size, separators[i:], text, length) if (at, stop) != (start, end) else _pieces(at, stop, size, separators[i + 1 :], text, length)
                at = stop
            return
    middle = (start + end) // 2  # no separator: halves
    yield from _pieces(start, middle, size, separators, text, length)
    yield from _pieces(middle, end, size, separators, text, length)


def split_text(text: str, size: int = 600, overlap: int = 90, length: Callable[[str], int] = count_tokens, known: dict | None = None) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most size tokens; neighbours share whole pieces of at most overlap tokens.

    The chunks cover every character but white space at a chunk's ends. A token that a cut splits may count twice. known
    keeps the tokens by (start, end), for other sizes of the same text.
    """
    known = {} if known is None else known

    def counted(a: int, b: int) -> int:
        n = known.get((a, b))
        if n is None:
            n = known[a, b] = length(text[a:b])
        return n

    chunks: list[tuple[int, int]] = []
    held: list[tuple[int, int, int]] = []
    total = 0
    for a, b in _pieces(0, len(text), size, SEPARATORS, text, counted):
        n = counted(a, b)
        if held and total + n > size:
            chunks.append((held[0][0], held[-1][1]))
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[2]
        held.append((a, b, n))
        total += n
    if held:
        chunks.append((held[0][0], held[-1][1]))
    found = []
    for a, b in chunks:
        body = text[a:b]
        lead = len(body) - len(body.lstrip())
        if body.strip():
            found.append((a + lead, a + lead + len(body.strip())))
    return found


def chunk_docs(full: DataFrame, size: int = 600, overlap: int = 90, length: Callable[[str], int] = count_tokens) -> DataFrame:
    """(doc_id, chunk_index, start, end, text, n_tokens) of full texts (doc_id, full_text)."""

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                rows += [(doc_id, i, a, b, text[a:b], length(text[a:b])) for i, (a, b) in enumerate(split_text(text, size, overlap, length))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "chunk_index", "start", "end", "text", "n_tokens"])

    return full.select(F.col("doc_id").cast("long"), "full_text").mapInArrow(run, "doc_id long, chunk_index int, start long, end long, text string, n_tokens int")


def section_asof(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index, start, …) with seg_no of the last segment (doc_id, seg_no, start) that starts at or before.

    One sort by document and position of both sides together, not a range join.
    """
    both = chunks.select("doc_id", "start", F.col("chunk_index"), F.lit(None).cast("int").alias("seg_no")).unionByName(
        segments.select("doc_id", "start", F.lit(None).cast("int").alias("chunk_index"), F.col("seg_no").cast("int"))
    )
    order = Window.partitionBy("doc_id").orderBy("start", F.col("seg_no").isNull(), "seg_no")
    return both.withColumn("seg_no", F.last("seg_no", ignorenulls=True).over(order)).where("chunk_index is not null").select("doc_id", "chunk_index", "start", "seg_no")


def chunk_overlap(chunks: DataFrame) -> DataFrame:
    """chunks with the characters that each shares with the one before; 0 for the first."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("overlap", F.greatest(F.lit(0), F.coalesce(F.lag("end").over(order) - F.col("start"), F.lit(0))).cast("long"))


def overlap_share(chunks: DataFrame) -> DataFrame:
    """One row: the boundaries between chunks of a document, those that overlap, and their percentage."""
    inner = chunk_overlap(chunks).where("chunk_index > 0")
    return inner.agg(F.count("*").alias("boundaries"), F.count_if(F.col("overlap") > 0).alias("overlapping")).withColumn(
        "percent", F.round(100.0 * F.col("overlapping") / F.nullif(F.col("boundaries"), F.lit(0)), 4)
    )


def coverage_sweep(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, a, b, depth): the text cut at every start and end of a chunk and start of a segment; depth counts chunks.

    Chunks open and close a running count in one sort by document, so no range join is needed.
    """
    opens = chunks.select("doc_id", F.col("start").alias("a"), F.lit(1).alias("step"))
    closes = chunks.select("doc_id", F.col("end").alias("a"), F.lit(-1).alias("step"))
    marks = starts.select("doc_id", F.col("start").alias("a"), F.lit(0).alias("step"))
    steps = opens.union(closes).union(marks).groupBy("doc_id", "a").agg(F.sum("step").alias("step"))
    order = Window.partitionBy("doc_id").orderBy("a")
    swept = steps.withColumn("depth", F.sum("step").over(order)).withColumn("b", F.lead("a").over(order))
    return swept.where("b is not null").select("doc_id", "a", "b", "depth")


def chunk_rows(chunks: DataFrame, segments: DataFrame, meta: DataFrame, header: bool = True) -> DataFrame:
    """The chunk table: id, text with its context header, flattened metadata, page 0 and section '' for none.

    meta has doc_id, title, authors (array), year, era, source_type, document_type, url; segments has seg_no, start, page, section.
    """
    placed = section_asof(chunks, segments).join(segments.select("doc_id", "seg_no", "page", "section"), ["doc_id", "seg_no"], "left")
    rows = chunks.drop("start").join(placed.drop("start", "seg_no"), ["doc_id", "chunk_index"]).join(meta, "doc_id")
    text = F.concat(T.chunk_header(F.col("title"), F.col("year"), F.col("section")), "text") if header else F.col("text")
    return rows.select(
        T.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"), text.alias("text"), "doc_id", "title", F.array_join("authors", ", ").alias("authors"), F.col("year").cast("int"),
        "era", "source_type", "document_type", "url", "chunk_index", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("section", F.lit("")).alias("section"),
    )


#: Variants of the chunking: name, tokens, overlap, whether chunks carry their header.
VARIANTS = (("300", 300, 45, True), ("600", 600, 90, True), ("600 bare", 600, 90, False), ("1200", 1200, 180, True))


def ablation_chunks(full: DataFrame, headers: DataFrame | None, variants=VARIANTS, length: Callable[[str], int] = count_tokens) -> DataFrame:
    """(variant, doc_id, chunk_index, text, n_tokens) of every variant of full texts, in one pass over them.

    headers (doc_id, header) go in front of the chunks of the variants that carry them; n_tokens counts the chunk with it.
    Without headers, full has the column header itself, and no text is shuffled.
    """

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for doc_id, text, header in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                known: dict = {}
                for name, size, overlap, headed in variants:
                    for i, (a, b) in enumerate(split_text(text or "", size, overlap, length, known)):
                        chunk = ((header or "") if headed else "") + text[a:b]
                        rows.append((name, doc_id, i, chunk, length(chunk)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["variant", "doc_id", "chunk_index", "text", "n_tokens"])

    headed = full if headers is None else full.join(headers.select("doc_id", "header"), "doc_id", "left")
    rows = headed.select(F.col("doc_id").cast("long"), "full_text", "header")
    return rows.mapInArrow(run, "variant string, doc_id long, chunk_index int, text string, n_tokens int")


def ablation(chunks: DataFrame) -> DataFrame:
    """(variant, chunks, tokens, median_tokens, max_tokens) of ablation_chunks, in one job."""
    return chunks.groupBy("variant").agg(
        F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"), F.percentile("n_tokens", 0.5).alias("median_tokens"), F.max("n_tokens").alias("max_tokens")
    )


def ablation_retrieval(hits: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """(variant, questions, hit1, hit5, evidence_hits, evidence_n, context_tokens): what each variant's first five chunks hold.

    hits: (variant, qid, rank, doc_id, text, n_tokens), five a question; questions: (qid, evidence), an expression or null;
    gold: (qid, doc_id). context_tokens is the mean over the questions of their five chunks' tokens, rounded half to even.
    """
    right = gold.select("qid", "doc_id", F.lit(True).alias("_right")).distinct()
    rows = hits.join(questions.select("qid", "evidence"), "qid").join(right, ["qid", "doc_id"], "left")
    each = rows.groupBy("variant", "qid").agg(
        F.min(F.when(F.col("_right"), F.col("rank"))).alias("first"), F.bool_or(F.rlike("text", F.col("evidence"))).alias("found"), F.sum("n_tokens").alias("tokens")
    )
    return each.groupBy("variant").agg(
        F.count("*").alias("questions"), F.count_if(F.col("first") == 1).alias("hit1"), F.count_if(F.col("first") <= 5).alias("hit5"),
        F.count_if("found").alias("evidence_hits"), F.count("found").alias("evidence_n"), F.bround(F.avg("tokens")).cast("long").alias("context_tokens"),
    )


#: Characters of the texts whose pieces a task holds as Python objects at once.
PIECE_BYTES = 1 << 18


def token_pieces(texts: DataFrame, encode: Callable[[str], list[tuple[int, str]]]) -> DataFrame:
    """(doc_id, pos, token_id, piece) of texts (doc_id, text) under a tokenizer given as a function to (id, piece) pairs."""

    def run(batches):
        for batch in sliced(batches, PIECE_BYTES):
            found = [encode(t or "") for t in batch.column(1).to_pylist()]
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids, pieces = pa.array([i for f in found for i, _ in f], pa.int64()), pa.array([p for f in found for _, p in f], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array(pos, pa.int32()), ids, pieces], names=["doc_id", "pos", "token_id", "piece"])

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, pos int, token_id long, piece string")
