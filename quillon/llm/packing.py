"""Harmonic packing of token sequences into fixed windows.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], and a sequence of class k holds
exactly k pieces. A document gives full sequences first; from what is left, the largest exact share C//k is cut off until
at most `whole` tokens remain, which go uncut to their own class. So a filled sequence of class k pads at most C mod k
tokens when its pieces are shares, and the small rests pad at most one part in k + 1. Every worker (input partition)
fills its classes by itself. The sequences it can't fill are laid end to end, cut at the capacity, and the last one is
cut into powers of two, which need no padding. No shuffle takes place; memory holds one batch and, for each class, fewer
pieces than one sequence has.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def tokenizer_files() -> dict[str, str]:
    """Paths of the public vocabulary that the queries use; both files hold the same one."""
    import public_tokenizers

    return {"json": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def ranks_of(files: dict[str, str]) -> dict[bytes, int]:
    """The ids of the vocabulary's pieces."""
    with open(files["ranks"], "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(files: dict[str, str]):
    """text -> uint32 ids. The rank file gives the ids of the JSON file's tokenizer several times as fast.

    Its expression engine gives up on runs of hundreds of thousands of spaces; the JSON file's tokenizer then takes the text.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(files["json"], encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    ranks = ranks_of(files)
    encoding = tiktoken.Encoding("public", pat_str=files["pattern"], mergeable_ranks=ranks, special_tokens=special)
    slow: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except ValueError:
            if not slow:
                slow.append(Tokenizer.from_file(files["json"]))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def cuts(n: int, capacity: int, whole: int) -> list[tuple[int, int]]:
    """(class, length) of the pieces of n tokens, in order."""
    found = [(1, capacity)] * (n // capacity)
    n %= capacity
    while n > whole:
        k = -(-capacity // n)
        found.append((k, capacity // k))
        n -= capacity // k
    if n:
        found.append((capacity // n, n))
    return found


class Packer:
    """The classes of one worker. Pieces are (document number, start, length)."""

    def __init__(self, first_id: int, capacity: int = 2048, whole: int = 64) -> None:
        self.next, self.capacity, self.whole = first_id, capacity, whole
        self.open: dict[int, list[tuple]] = {}

    def _emit(self, pieces: list[tuple]) -> list[tuple]:
        found, offset = [], 0
        for doc, start, ids in pieces:
            found.append((doc[0], start, len(ids), zlib.crc32(ids.tobytes()), doc[1], self.next, offset))
            offset += len(ids)
        self.next += 1
        return found

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        """Takes a document's ids; returns the rows of the sequences that this fills."""
        rows, start, doc = [], 0, (doc_id, len(ids))
        for k, n in cuts(len(ids), self.capacity, self.whole):
            held = self.open.setdefault(k, [])
            held.append((doc, start, ids[start : start + n] if k == 1 else ids[start : start + n].copy()))
            start += n
            if len(held) == k:
                rows += self._emit(self.open.pop(k))
        return rows

    def close(self) -> list[tuple]:
        """Lays the unfilled sequences end to end; the last sequence becomes powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in pieces)
        rows, room, held = [], 0, []
        while pieces:
            if not room:
                room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                left -= room
            doc, start, ids = pieces.pop(0)
            held.append((doc, start, ids[:room]))
            if len(ids) > room:
                pieces.insert(0, (doc, start + room, ids[room:]))
            room -= min(room, len(ids))
            if not room:
                rows += self._emit(held)
                held = []
        return rows


def pack(docs: DataFrame, files: dict[str, str] | None = None, capacity: int = 2048, end_id: int = 1, whole: int = 64) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one for each piece of each document.

    docs has doc_id and text; other columns are ignored. A document is the ids of its whole text and end_id; a null text
    counts as empty, so it is that one id. A null doc_id is kept as null, repeated rows are documents of their own, an
    empty table gives no rows. Each id lies in exactly one piece. sequence_id is unique but has gaps between workers.
    """
    files = files or tokenizer_files()

    def run(batches):
        encode = encoder(files)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, whole)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                rows += packer.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4", copy=False))
                if len(rows) >= 50_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
        yield _batch(packer.close())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=NAMES)
