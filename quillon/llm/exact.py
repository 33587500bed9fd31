"""Exact deduplication through a log-structured merge index of digests.

Each task gathers digests in a memtable, which keeps one entry a digest (the best row and a count), and flushes it as a
run, sorted and headed by a Bloom filter of its digests, when it is full. Compaction first asks the filters: an entry that
no other run's filter may hold is compact as it is and is not moved. The others are dealt out by digest, sorted, and merged
in one pass over each sorted run; the best row stays: the longest original, then the smallest identifier. Where the
filters together outgrow FILTERS_BYTES, all entries are merged. A filter over the digests that have several rows, of
bounded size, decides which texts are read again; those hits are compared byte for byte with the row that stays. Texts
that only share a digest are grouped by their bytes instead, so the result does not rest on the digest. A digest with a
third of all rows is one entry for each memtable before anything is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import PROBES, checkpointed, filter_bits, filter_size, removed, sliced, stored

MEMTABLE_ROWS = 200_000
#: All runs' filters are sent to every task if they are within so many bytes; about 16 bits an entry.
FILTERS_BYTES = 16 << 20
_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, _WHITE)


def digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, chars, sha) for every row: code points of the original text, SHA-256 of the normalised one."""

    def run(batches):
        for batch in sliced(batches):
            sha = [hashlib.sha256(normalised(t)).digest() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha, pa.binary())], names=["doc_id", "chars", "sha"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.length(text).cast("long").alias("chars"), text.cast("binary")).mapInArrow(
        run, "doc_id long, chars long, sha binary"
    )


_RUN = "run long, key binary, chars long, doc_id long, row long, n long, filter binary"
_KINDS = dict(run=pa.int64(), key=pa.binary(), chars=pa.int64(), doc_id=pa.int64(), row=pa.int64(), n=pa.int64(), filter=pa.binary())


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[name]) for name, c in columns.items()], names=list(columns))


def _places(keys: list[bytes]) -> np.ndarray:
    """(keys x PROBES) places in a Bloom filter of any size, before the remainder is taken."""
    b = np.frombuffer(b"".join(k[:10].ljust(10, b"\0") for k in keys), dtype=np.uint8).reshape(-1, 10).astype(np.int64)
    h, g = (sum(b[:, at + i] << (8 * (4 - i)) for i in range(5)) for at in (0, 5))
    return h[:, None] + g[:, None] * np.arange(PROBES)


def run_filter(keys: list[bytes]) -> bytes:
    bits = np.zeros(filter_size(len(keys)), dtype=bool)
    bits[_places(keys) % len(bits)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def maybe_held(bits: bytes, places: np.ndarray) -> np.ndarray:
    """Which keys, by their places, the filter may hold."""
    at = places & (len(bits) * 8 - 1)
    return (np.frombuffer(bits, dtype=np.uint8)[at >> 3] >> (at & 7) & 1).all(axis=1)


def flush(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Runs (run, key, chars, doc_id, row, n, filter): a row with the run's filter and size, then its entries by key.

    For each memtable, an entry holds the best row of a key and the key's count.
    """

    def sealed(run: int, table: dict):
        keys = sorted(table)
        if keys:
            yield _batch(run=[run], key=[None], chars=[None], doc_id=[None], row=[None], n=[len(keys)], filter=[run_filter(keys)])
            best = [table[k] for k in keys]
            yield _batch(run=[run] * len(keys), key=keys, chars=[-b[0] for b in best], doc_id=[b[2] for b in best], row=[b[3] for b in best], n=[b[4] for b in best], filter=[None] * len(keys))

    def run(batches):
        table: dict[bytes, tuple] = {}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for key, chars, doc_id, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = (-chars, doc_id is None, doc_id, row)
                if (old := table.get(key)) is None:
                    table[key] = (*new, 1)
                    if len(table) >= memtable_rows:
                        yield from sealed(number, table)
                        number, table = number + 1, {}
                else:
                    table[key] = (*(new if _before(new, old) else old[:4]), old[4] + 1)
        yield from sealed(number, table)

    return rows.select("key", "chars", "doc_id", "row").mapInArrow(run, _RUN)


def _before(a: tuple, b: tuple) -> bool:
    """Whether entry a = (-chars, no id, id, row, ...) comes before b."""
    return (a[0], a[1], a[2] or 0, a[3]) < (b[0], b[1], b[2] or 0, b[3])


def _contested(runs: DataFrame, filters: list[tuple[int, bytes]]) -> DataFrame:
    """The runs' entries with `contested`: whether another run's filter may hold the key."""
    shared = runs.sparkSession.sparkContext.broadcast(filters)

    def mark(batches):
        for batch in batches:
            own, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            places, found = _places(keys), np.zeros(len(keys), dtype=bool)
            for run, bits in shared.value:
                ask = np.flatnonzero(~found & (own != run))
                found[ask] = maybe_held(bits, places[ask])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "contested"])

    entries = runs.where("key is not null").drop("filter")
    return entries.mapInArrow(mark, _RUN.replace("filter binary", "contested boolean"))


def _merged(entries: DataFrame) -> DataFrame:
    """One entry a key of the entries (key, chars, doc_id, row, n): they are dealt out by key, sorted, and merged in one pass."""

    def run(batches):
        last = None  # (key, (-chars, no id, id, row), n), until the next key comes

        for batch in batches:
            out = []
            for key, chars, doc_id, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = (-chars, doc_id is None, doc_id, row)
                if last and last[0] == key:
                    last = (key, new if _before(new, last[1]) else last[1], last[2] + n)
                else:
                    out += [last] if last else []
                    last = (key, new, n)
            yield sealed(out)
        yield sealed([last] if last else [])

    def sealed(out):
        return _batch(key=[k for k, _, _ in out], chars=[-b[0] for _, b, _ in out], doc_id=[b[2] for _, b, _ in out], row=[b[3] for _, b, _ in out], n=[n for _, _, n in out])

    ready = entries.select("key", "chars", "doc_id", "row", "n").repartition("key").sortWithinPartitions("key")
    return ready.mapInArrow(run, "key binary, chars long, doc_id long, row long, n long")


def compact(runs: DataFrame) -> DataFrame:
    """One entry (key, keep_id, keep_chars, keep_row, n) for each key of the runs, which must be cheap to read."""
    heads = runs.where("key is null")
    size = heads.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size <= FILTERS_BYTES:
        marked = checkpointed(_contested(runs, [(r["run"], bytes(r["filter"])) for r in heads.select("run", "filter").collect()]))
        entries = _merged(marked.where("contested")).union(marked.where("not contested").select("key", "chars", "doc_id", "row", "n"))
    else:
        entries = _merged(runs.where("key is not null"))
    return entries.select("key", F.col("doc_id").alias("keep_id"), F.col("chars").alias("keep_chars"), F.col("row").alias("keep_row"), "n")


def hit_filter(keys: DataFrame) -> bytes:
    """A Bloom filter, of bounded size, over the binary column key."""
    size = filter_size(keys.count())
    h, g = (F.conv(F.hex(F.rpad(F.substring("key", a, 5), 5, F.lit(b"\0"))), 16, 10).cast("long") for a in (1, 6))
    return filter_bits(keys.select(F.explode(F.array(*[F.pmod(h + g * F.lit(i), F.lit(size)) for i in range(PROBES)])).alias("p")), size)


def _in_filter(bits: bytes, key: bytes) -> bool:
    h, g = int.from_bytes(key[:5].ljust(5, b"\0")), int.from_bytes(key[5:10].ljust(5, b"\0"))
    size = len(bits) * 8
    return all(bits[(p := (h + i * g) % size) >> 3] >> (p & 7) & 1 for i in range(PROBES))


def _false_hits(docs: DataFrame, index: DataFrame, digest_bytes: int) -> DataFrame:
    """Rows (doc_id, chars, key, norm) whose normalised text differs from that of the row that their key keeps."""
    several = index.where("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(hit_filter(several.select("key")))

    def run(batches):
        bits = shared.value
        for batch in sliced(batches):
            out = [], [], [], []
            for doc_id, chars, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                norm = normalised(text)
                key = hashlib.sha256(norm).digest()[:digest_bytes]
                if _in_filter(bits, key):
                    for column, value in zip(out, (doc_id, chars, key, norm), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "chars", "key", "norm"])

    text = F.coalesce("text", F.lit(""))
    # Stored, as they are read twice.
    hits, path = stored(
        docs.select(F.col("doc_id").cast("long"), F.length(text).cast("long").alias("chars"), text.cast("binary")).mapInArrow(
            run, "doc_id long, chars long, key binary, norm binary"
        )
    )
    one = several.select(F.col("key").alias("k"), "keep_id", "keep_chars")
    kept = checkpointed(
        hits.join(one, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")))
        .groupBy("k")
        .agg(F.min("norm").alias("kept_norm"))
    )  # of its own, so that the join below can be split where a key has many rows
    wrong = checkpointed(hits.join(kept, F.col("key") == F.col("k")).where("norm != kept_norm").select("doc_id", "chars", "key", "norm"))
    removed(docs.sparkSession, path)
    return wrong


def exact_duplicates(docs: DataFrame, digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text), kept or not.

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty. Of equal
    texts the row with the most code points in the original text stays, then the smallest doc_id, null last; of repeated
    rows that tie, exactly one is kept. keep_id is null where a row without an id stays. An empty table gives no rows.
    Other columns are ignored. digest_bytes shortens the digest, for tests: the result is the same.
    """
    rows = checkpointed(digests(docs).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("key", F.substring("sha", 1, digest_bytes))
    index = checkpointed(compact(checkpointed(flush(rows, memtable_rows))))
    wrong = _false_hits(docs, index, digest_bytes)
    looked_up = rows.join(index.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).drop("k")
    if not wrong.isEmpty():
        # Texts that share a digest and differ: their own groups by bytes, the rest of the key's group without them.
        groups = wrong.join(rows.select("doc_id", "chars", "key", "row"), ["chars", "key"]).where(wrong["doc_id"].eqNullSafe(rows["doc_id"]))
        groups = groups.select(rows["doc_id"], "chars", "key", "row", F.sha2("norm", 512).alias("text_key")).distinct()
        first = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        best = groups.groupBy("key", "text_key").agg(first.alias("b"), F.count("*").alias("m"))
        own = groups.join(best, ["key", "text_key"]).select(
            F.col("row").alias("r"), F.col("b.doc_id").alias("own_id"), F.col("b.row").alias("own_row"), "m"
        )
        less = groups.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("gone"))
        looked_up = (
            looked_up.join(own, F.col("row") == F.col("r"), "left")
            .join(less, F.col("key") == F.col("k"), "left")
            .withColumn("keep_id", F.when(F.col("r").isNull(), F.col("keep_id")).otherwise(F.col("own_id")))
            .withColumn("keep_row", F.when(F.col("r").isNull(), F.col("keep_row")).otherwise(F.col("own_row")))
            .withColumn("n", F.when(F.col("r").isNull(), F.col("n") - F.coalesce("gone", F.lit(0))).otherwise(F.col("m")))
        )
    return looked_up.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
