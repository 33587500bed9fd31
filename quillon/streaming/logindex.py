"""The chunk index as a log-structured table: immutable batches, tombstones, compaction, one manifest as the commit.

A folder holds `chunks/` and `state/`, a subfolder for each batch, and `manifests/`, one file for each version. A batch's
state names each document that it changed, with the new fingerprint, or with none for a document that is gone (a
tombstone); the last batch that names a document decides. A batch is written whole before its manifest, which lists all
batches of the version, is put in place whole, unless the version exists by then. So a reader sees whole versions
only, a writer that is killed leaves the old version as it was, and of two writers one is told to start again. Files of
batches that no manifest lists are garbage, which vacuum() removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.indexing import fingerprint
from quillon.session import created_once, durable, removed

STATE = "doc_id long, fingerprint string"
#: Batches that a version may list before an upsert compacts them.
MOST_BATCHES = 8


class Conflict(Exception):
    """Another writer has committed the version that this one was about to."""


class LogIndex:
    """An index at a path that all executors share. chunker makes chunks (doc_id, …) of documents (doc_id, text)."""

    def __init__(self, spark: SparkSession, path: str, chunker: Callable[[DataFrame], DataFrame], settings: str = "600/90/true", most: int = MOST_BATCHES) -> None:
        self.spark, self.path, self.chunker, self.settings, self.most = spark, path.rstrip("/"), chunker, settings, most
        jvm = spark.sparkContext._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._files = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Versions

    def versions(self) -> list[int]:
        """The numbers of the committed versions; none for a folder that isn't there."""
        if not self._files.exists(self._at("manifests")):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._at("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, batches: [{id, number}], applied: {source: batch}} of a version, the last one by default; version 0 has none."""
        known = self.versions()
        if not known:
            return {"version": 0, "batches": [], "applied": {}}
        name = f"{version or known[-1]:012d}.json"
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/manifests/{name}").first()[1])

    def _commit(self, old: dict, batches: list[dict], applied: dict) -> dict:
        new = {"version": old["version"] + 1, "batches": batches, "applied": applied}
        if not created_once(self.spark, f"{self.path}/manifests/{new['version']:012d}.json", json.dumps(new).encode()):
            raise Conflict(f"version {new['version']} of {self.path} is there already")
        return new

    # Reading

    def _parts(self, kind: str, manifest: dict, schema: str) -> DataFrame:
        found = None
        for b in manifest["batches"]:  # at most `most` and one
            part = self.spark.read.parquet(f"{self.path}/{kind}/{b['id']}").withColumn("batch", F.lit(b["number"]))
            found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], schema) if found is None else found

    def _last(self, manifest: dict) -> DataFrame:
        """(doc_id, fingerprint, batch) of each document's last batch, tombstones included."""
        rows = self._parts("state", manifest, f"{STATE}, batch long")
        return rows.groupBy("doc_id").agg(F.max(F.struct("batch", "fingerprint")).alias("r")).select("doc_id", "r.fingerprint", F.col("r.batch").cast("long").alias("batch"))

    def state(self, version: int | None = None) -> DataFrame:
        """(doc_id, fingerprint, batch): one row for each document that is there."""
        return self._last(self.manifest(version)).where("fingerprint is not null")

    def chunks(self, version: int | None = None) -> DataFrame:
        """The chunks of the documents that are there, each of its document's last batch."""
        manifest = self.manifest(version)
        if not manifest["batches"]:
            return self.chunker(self.spark.createDataFrame([], "doc_id long, text string"))
        live = self._last(manifest).where("fingerprint is not null").select("doc_id", "batch")
        rows = self._parts("chunks", manifest, "")
        return rows if len(manifest["batches"]) == 1 else rows.join(live.withColumn("batch", F.col("batch").cast("int")), ["doc_id", "batch"], "left_semi").select(rows.columns)

    # Writing

    def _fingerprints(self, docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
        """(doc_id, text, fingerprint), a row for each id; of repeated ids the largest text, a null text if it is the only one."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fingerprint(F.col("text"), {"doc_id": F.col("doc_id"), **fields}, self.settings).alias("fingerprint"))
        first = Window.partitionBy("doc_id").orderBy(F.col("text").desc_nulls_last(), F.desc("fingerprint"))
        rows = rows.where("doc_id is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        return rows.withColumn("fingerprint", F.when(F.col("text").isNotNull(), F.col("fingerprint")))

    def upsert(self, docs: DataFrame, whole: bool = False, fields: dict[str, Column] | None = None, source: tuple[str, int] | None = None) -> dict:
        """Takes in documents (doc_id, text) and gives the new manifest, or the old one where nothing changed.

        Only documents whose fingerprint (text, fields, settings) changed are cut into chunks. A row with a null text
        deletes its document; with `whole`, docs are all documents, and those that it lacks are deleted too. Rows with a
        null doc_id are left out. source (name, number) tells a stream's batch, so that one which is sent again after a
        failure isn't taken twice. On an empty or missing folder this starts the index.
        """
        old = self.manifest()
        if source and old["applied"].get(source[0], -1) >= source[1]:
            return old
        applied = old["applied"] | ({source[0]: source[1]} if source else {})
        known = self._last(old).where("fingerprint is not null").select("doc_id", F.col("fingerprint").alias("_old"))
        rows = self._fingerprints(docs, fields or {})
        joined = rows.withColumn("_here", F.lit(True)).join(known, "doc_id", "full" if whole else "left")
        kept = F.col("_here") & F.col("fingerprint").isNotNull()
        new = joined.where(kept & ~F.col("fingerprint").eqNullSafe(F.col("_old"))).select("doc_id", "text", "fingerprint")
        gone = joined.where(F.coalesce(~kept, F.lit(True)) & F.col("_old").isNotNull()).select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fingerprint"))
        changed = durable(new.union(gone))
        if changed.isEmpty():
            return self._commit(old, old["batches"], applied) if source else old
        batch = self._write(changed.select("doc_id", "fingerprint"), self.chunker(changed.where("fingerprint is not null").select("doc_id", "text")), old)
        made = self._commit(old, [*old["batches"], batch], applied)
        return self.compact() if len(made["batches"]) > self.most else made

    def _write(self, state: DataFrame, chunks: DataFrame, old: dict) -> dict:
        batch = {"id": uuid.uuid4().hex, "number": old["version"] + 1}
        chunks.write.parquet(f"{self.path}/chunks/{batch['id']}")
        state.write.parquet(f"{self.path}/state/{batch['id']}")
        return batch

    def compact(self) -> dict:
        """One batch in place of all: the live documents' chunks, and a state without tombstones."""
        old = self.manifest()
        if not old["batches"]:
            return old
        chunks = self.chunks()
        batch = self._write(self.state().select("doc_id", "fingerprint"), chunks.drop("batch"), old)
        return self._commit(old, [batch], old["applied"])

    def rebuild(self) -> dict:
        """A version without documents; the next upsert makes all chunks anew. Older versions stay until vacuum()."""
        return self._commit(self.manifest(), [], {})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last `keep` manifests, and the batches that none of these lists; returns the batches' ids.

        No writer may be at work, since its batch isn't listed yet.
        """
        known = self.versions()
        listed = {b["id"] for v in known[-keep:] for b in self.manifest(v)["batches"]}
        for v in known[:-keep]:
            removed(self.spark, f"{self.path}/manifests/{v:012d}.json")
        gone = set()
        for kind in ("chunks", "state"):
            at = self._at(kind)
            for f in self._files.listStatus(at) if self._files.exists(at) else ():
                name = f.getPath().getName()
                if name not in listed:
                    removed(self.spark, f"{self.path}/{kind}/{name}")
                    gone.add(name)
        return sorted(gone)


def index_stream(index: LogIndex, source: str, schema: str, checkpoint: str, name: str = "files"):
    """A query that keeps an index up to date with new files of JSON lines (doc_id, text); a null text deletes.

    A batch that runs again after a failure finds its number in the manifest, or the batch before it, and is taken once.
    """
    stream = index.spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(lambda df, n: index.upsert(df, source=(name, n)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True)
