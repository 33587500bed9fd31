"""Substring deduplication by Rabin-Karp hashes of every window of a fixed number of words.

1. Every document's word hashes give a polynomial hash of each half window. The smallest one within a window is the
   window's anchor, so equal windows have equal anchors. A document's distinct anchors, about two for each window length,
   are counted over the corpus. A window whose anchor lies in one document only can't repeat in another.
2. The windows with a shared anchor get two 64-bit Rabin-Karp hashes, one row for each distinct window of a document;
   Spark takes the smallest doc_id of each. Documents equal as a whole are settled by one hash and skip this step.
3. A document's windows that start in a smaller document go back to it as a list; repeated windows merge into maximal
   intervals, and the other words are kept.

Texts are shuffled only where a Bloom filter of bounded size may hold their document: those with a shared anchor, then
those that lose words. Counts are combined before each shuffle and joined back by shuffle joins that can be split, so a passage in a third of
all documents is spread. A list holds one document's own windows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, id_filter, may_hold, sliced

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)]) for b in (base, inverse))


def rolling(h: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """Polynomial hashes mod 2^64 of every `width` consecutive entries of h; empty if there are fewer."""
    n = len(h)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(base, 1 << max(12, (n - 1).bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * power[:n], out=sums[1:])
    found = (sums[width:] - sums[:-width]) * inverse[: n - width + 1]
    return found ^ (found >> np.uint64(31))


def whole_hash(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` words, the smallest hash of its half windows."""
    half = max(1, width // 2)
    low, span = rolling(h, half), width - half + 1
    size = 1
    while size * 2 <= span and len(low):
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (span - size)], low[span - size :]) if len(low) > span - size else low[:0]


def prints(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, whole, anchors) for documents with an id and at least one window."""

    def run(batches):
        for batch in sliced(batches):
            ids, whole, lists = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                if len(words) >= width:
                    ids.append(doc_id)
                    whole.append(whole_hash(words))
                    lists.append(np.unique(anchors(word_hashes(words), width)).view(np.int64))
            offsets = np.cumsum([0, *map(len, lists)])
            flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["doc_id", "whole", "anchors"],
            )

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, whole binary, anchors array<long>")


def windows(docs: DataFrame, width: int) -> DataFrame:
    """Rows (h1, h2, doc_id): each distinct window of docs (doc_id, text, hot) whose anchor is in the list hot."""

    def run(batches):
        for batch in sliced(batches):
            for i in range(batch.num_rows):
                h = word_hashes(batch.column(1)[i].as_py().split())
                hot = batch.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.isin(anchors(h, width), hot)
                found = np.unique(np.stack([rolling(h, width, b)[at].view(np.int64) for b in _BASES], axis=1), axis=0)
                ids = np.full(len(found), batch.column(0)[i].as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found[:, 0].copy(), found[:, 1].copy(), ids)], names=["h1", "h2", "doc_id"])

    return docs.mapInArrow(_coalesced(run), "h1 long, h2 long, doc_id long")


def _coalesced(run, rows: int = 20_000):
    """run, with its small batches joined."""

    def joined(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal [start, end) intervals covered by windows that start at the sorted positions."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > width)
    first = starts[np.r_[0, breaks + 1]]
    last = starts[np.r_[breaks, len(starts) - 1]] + width
    return list(zip(first.tolist(), last.tolist(), strict=True))


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text) for every row of docs (doc_id, text; other columns are ignored).

    Words are [^\\x20\\x09-\\x0D]+, unchanged; a null text has none. A word goes if a window of `width` words covers it
    whose word sequence also starts in a document with a smaller doc_id; windows are judged on the input. kept_text joins
    the other words by a space. A row with a null doc_id loses nothing and takes nothing from others. Rows that share a
    doc_id count as parts of one document and keep what they repeat of each other. An empty table gives no rows. Windows
    are told apart by 128 hash bits.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    found = checkpointed(prints(texts, width))
    first = checkpointed(found.groupBy("whole").agg(F.min("doc_id").alias("first")))  # see below
    # A copy of a smaller document goes whole: none of its windows needs to be looked at, and it is never the first.
    copies = checkpointed(found.select("doc_id", "whole").join(first, "whole").where("doc_id > first").select("doc_id", "whole"))
    alone = found.join(copies, ["doc_id", "whole"], "left_anti")
    places = alone.select(F.explode("anchors").alias("anchor"), "doc_id")
    shared = places.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = checkpointed(shared)  # of its own, so that the joins with it can be split where an anchor is hot
    hot = checkpointed(places.join(shared, "anchor").groupBy(F.col("doc_id").alias("hot_id")).agg(F.collect_list("anchor").alias("hot")))
    looked = _held(texts, docs.sparkSession.sparkContext.broadcast(id_filter(hot.select(F.col("hot_id").alias("id"))))).join(hot, F.col("doc_id") == F.col("hot_id")).select("doc_id", "text", "hot")
    rows = checkpointed(windows(looked, width))
    least = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first")
    gone = rows.join(checkpointed(least), ["h1", "h2"]).where("doc_id > first").groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    wholes = copies.groupBy(F.col("doc_id").alias("copy_id")).agg(F.collect_set("whole").alias("wholes"))
    gone = gone.join(wholes, F.col("gone_id") == F.col("copy_id"), "full").select(F.coalesce("gone_id", "copy_id").alias("gone_id"), "gone", "wholes")
    gone = checkpointed(gone)
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(gone.select(F.col("gone_id").alias("id"))))
    cut = _held(texts, shared).join(gone, F.col("doc_id") == F.col("gone_id"), "left").select("doc_id", "text", "gone", "wholes")
    schema = "doc_id long, n_words long, n_removed long, kept binary"
    found = cut.mapInArrow(_cutter(width), schema).union(texts.mapInArrow(_whole(shared), schema))
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def _held(texts: DataFrame, shared) -> DataFrame:
    """The rows of texts whose id the shared filter may hold: only texts that matter are shuffled."""

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array(may_hold(shared.value, batch.column(0).to_pylist())))

    return texts.mapInArrow(run, "doc_id long, text binary")


def _whole(shared):
    """The other rows, which lose nothing, as (doc_id, n_words, n_removed, kept)."""

    def run(batches):
        for batch in sliced(batches):
            batch = batch.filter(pa.array(~may_hold(shared.value, batch.column(0).to_pylist())))
            words = [(t or b"").split() for t in batch.column(1).to_pylist()]
            columns = [pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([b" ".join(w) for w in words], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def among(a: np.ndarray, b: np.ndarray, gone_a: np.ndarray, gone_b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) are among the pairs (gone_a, gone_b)."""
    order = np.lexsort((gone_b, gone_a))
    gone_a, gone_b = gone_a[order], gone_b[order]
    first, last = np.searchsorted(gone_a, a, "left"), np.searchsorted(gone_a, a, "right")
    found = np.zeros(len(a), dtype=bool)
    for step in range(int((last - first).max(initial=0))):  # once, unless pairs share their first half
        at = np.flatnonzero(first + step < last)
        found[at] |= gone_b[first[at] + step] == b[at]
    return found


def _cutter(width: int):
    """Batches (doc_id, text, gone, wholes) to (doc_id, n_words, n_removed, kept)."""

    def run(batches):
        for batch in sliced(batches):
            ids, counts, removed, kept = batch.column(0), [], [], []
            for i, (text, wholes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = (text or b"").split()
                counts.append(len(words))
                if wholes and whole_hash(words) in wholes:
                    words = []
                elif batch.column(2)[i].is_valid and len(words) >= width:
                    h, gone = word_hashes(words), batch.column(2)[i].values
                    starts = np.flatnonzero(among(*[rolling(h, width, b).view(np.int64) for b in _BASES], *[gone.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
                    at, left = 0, []
                    for lo, hi in intervals(starts, width):
                        left += words[at:lo]
                        at = hi
                    words = left + words[at:]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    return run
