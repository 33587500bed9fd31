"""Sources and sinks with fixed schemas."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

MANIFEST = (
    "id string not null, title string not null, authors array<string>, year int, era string, source_type string, document_type string, format string, url string, license string, why string, enables array<string>, pages string, notes string"
)
CHUNKS = "id string, text string, metadata struct<doc_id:string,title:string,authors:string,year:int,era:string,source_type:string,document_type:string,url:string,chunk_index:int,page:int,section:string>"
STATE = "doc_id string, fingerprint string"
RUN_ID = r"^\d{8}-\d{4}"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The corpus manifest: YAML if a YAML library is there, else JSON; `documents` is a list of entries."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    try:
        import yaml

        documents = yaml.safe_load(text)["documents"]
    except ImportError:
        documents = json.loads(text)["documents"]
    schema = S.StructType.fromDDL(MANIFEST)
    return spark.createDataFrame([tuple(d.get(n) for n in schema.fieldNames()) for d in documents], schema)


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, format, content) of <folder>/<doc_id>.<format>."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("format"), "content", "length")


def wiki_text(content: Column) -> list[Column]:
    """text, revision and title fields of a wiki page's JSON."""
    page = F.from_json(content.cast("string"), "title string, text string, revision_id long, revision_timestamp string")
    return [page["title"].alias("title"), page["text"].alias("text"), page["revision_id"].alias("revision_id")]


def url_title(url: Column) -> Column:
    """The page title at the end of a wiki URL."""
    return F.replace(F.url_decode(F.element_at(F.split(url, "/"), -1)), F.lit("_"), F.lit(" "))


def load_segments(raw: DataFrame, loaders: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Segments of raw files by format: each loader takes its own rows; a format without a loader is a ValueError."""
    unknown = [r["format"] for r in raw.select("format").distinct().collect() if r["format"] not in loaders]  # a row a format
    if unknown:
        raise ValueError(f"no loader for {', '.join(map(str, sorted(unknown, key=str)))}")
    parts = [load(raw.where(F.col("format") == kind)) for kind, load in loaders.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


def inspected(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, bytes, avg_chars, scanned) of page texts (doc_id, page, text); under 200 characters a page is a scan.

    The average is rounded half to even.
    """
    rows = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    average = F.rint(F.col("chars") / F.greatest(F.col("pages"), F.lit(1))).cast("long")
    return rows.select("doc_id", "pages", "chars", "bytes", average.alias("avg_chars"), (average < 200).alias("scanned"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk rows as JSON lines {id, text, metadata}, replacing what is there."""
    names = [f.name for f in S.StructType.fromDDL(CHUNKS)["metadata"].dataType]
    chunks.select("id", "text", F.struct(*names).alias("metadata")).write.mode("overwrite").json(path)


def chunk_count(spark: SparkSession, path: str) -> int:
    """Chunks of the chunk file; 0 where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return 0
    return read_chunks(spark, path).count()


def index_ready(spark: SparkSession, path: str) -> bool:
    return chunk_count(spark, path) > 0


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def latest_run(runs: DataFrame, suffix: str = "") -> DataFrame:
    """The row with the last run_id that ends in suffix; run ids sort by time."""
    return runs.where(F.col("run_id").rlike(RUN_ID) & F.endswith("run_id", F.lit(suffix))).orderBy(F.desc("run_id")).limit(1)


def _within(rows: DataFrame, limit: int) -> list:
    """All rows, which a page can show; more than `limit` are a ValueError, since they belong in a table."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows; write them with write_report")
    return found


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a summary of at most `limit` rows."""
    cell = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "/")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in _within(rows, limit)])


def markdown_report(title: str, parts: dict[str, DataFrame]) -> str:
    """A report: a title, and a heading and a table for each summary."""
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{markdown_table(rows)}" for name, rows in parts.items()]]) + "\n"


def html_claims(claims: DataFrame, limit: int = 1000) -> str:
    """An HTML list of at most `limit` claims (qid, claim, verdict, note), with & < > escaped in Spark."""
    from quillon.functions.text import escape_html

    rows = claims.orderBy("qid").select("qid", *[escape_html(F.coalesce(c, F.lit(""))).alias(c) for c in ("claim", "verdict", "note")])
    return "<ul>\n" + "\n".join(f"<li><b>{r['qid']}</b> {r['claim']} — {r['verdict']} {r['note']}</li>" for r in _within(rows, limit)) + "\n</ul>"


def viewer_payload(rows: DataFrame) -> DataFrame:
    """One JSON string a row for a page's script, with </ made harmless."""
    return rows.select(F.replace(F.to_json(F.struct("*")), F.lit("</"), F.lit("<\\/")).alias("payload"))


def exported(segments: DataFrame) -> DataFrame:
    """(doc_id, value): each document's cleaned text, its segments (doc_id, seg_no, text) in order, parted by empty lines."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda s: s["text"])
    return segments.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("value"))


def export_text(segments: DataFrame, doc_id, path: str) -> None:
    """One document's cleaned text as a text file."""
    exported(segments.where(F.col("doc_id") == doc_id)).select("value").coalesce(1).write.mode("overwrite").text(path)


def size_in_chars(tokens: Column, chars_per_token: Column) -> Column:
    """A size in tokens as characters, rounded to tens."""
    return F.round(tokens * chars_per_token, -1).cast("long")
