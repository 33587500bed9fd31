"""The incrementally updated index: fingerprints, what changed, what is gone, the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIPELINE_VERSION = "1"


def fingerprint(content: Column, fields: dict[str, Column], settings: str) -> Column:
    """SHA-256 of the raw content, the fields as JSON in key order, the settings and the pipeline's version."""
    entry = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(content.cast("binary"), F.concat(entry, F.lit(settings), F.lit(PIPELINE_VERSION)).cast("binary")), 256)


def changed_docs(current: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of current (doc_id, fingerprint) that state lacks or has under another fingerprint."""
    old = state.select("doc_id", F.col("fingerprint").alias("_old"))
    return current.join(old, "doc_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")


def removed_docs(current: DataFrame, state: DataFrame) -> DataFrame:
    """doc_id of the state that current lacks. A document whose raw file is gone counts as removed."""
    return state.select("doc_id").join(current.select("doc_id"), "doc_id", "left_anti")


def missing_raw(manifest: DataFrame, raw: DataFrame) -> DataFrame:
    """doc_id of the manifest's documents without a raw file: they are skipped, with a warning for whoever runs the ingest."""
    return manifest.select("doc_id").join(raw.select("doc_id"), "doc_id", "left_anti")


def upserted(rows: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without those of documents in new or gone, and new."""
    drop = new.select("doc_id").union(gone.select("doc_id")).distinct()
    return rows.join(drop, "doc_id", "left_anti").unionByName(new)


def ingest_report(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row about chunks (doc_id, n_tokens): documents, chunks, embedded_this_run, tokens total, median and maximum."""
    return chunks.agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens_total"), F.percentile("n_tokens", F.lit(0.5)).alias("tokens_median"), F.max("n_tokens").alias("tokens_max")
    ).join(F.broadcast(embedded.agg(F.countDistinct("doc_id").alias("embedded_this_run"))))


def chunks_by_document(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks): the report's other part, a row a document, since a map of all documents has no bound."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
