"""Model providers behind plain interfaces: retries, pacing by a rolling token budget, deterministic stand-ins."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.arrow import sliced

ATTEMPTS, BUDGET, SPAN = 12, 27_000, 60.0


def wait_seconds(message: str, attempt: int) -> float:
    """What `try again in 2.5s` or `… 300ms` asks for, and a tenth more; else two seconds for each attempt."""
    found = re.search(r"try again in ([0-9.]+)\s*(ms|s)\b", message)
    if not found:
        return 2.0 * (attempt + 1)
    return float(found[1]) * (0.001 if found[2] == "ms" else 1.0) * 1.1


def with_retries(call: Callable, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """call, tried again after the wait that its error names; the last error is raised."""

    def tried(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except Exception as error:
                if attempt + 1 == attempts:
                    raise
                sleep(wait_seconds(str(error), attempt))

    return tried


class Pacer:
    """Waits until the tokens of the last `span` seconds and the new ones are within the budget, or there are none."""

    def __init__(self, budget: int = BUDGET, span: float = SPAN, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.budget, self.span, self.now, self.sleep = budget, span, now, sleep
        self.window: list[tuple[float, int]] = []

    def admit(self, tokens: int) -> None:
        while True:
            now = self.now()
            self.window = [(t, n) for t, n in self.window if now - t < self.span]
            if not self.window or sum(n for _, n in self.window) + tokens <= self.budget:
                self.window.append((now, tokens))
                return
            self.sleep(self.window[0][0] + self.span - now + 0.1)


#: Words whose place and sign a worker keeps.
KNOWN_WORDS = 200_000


def stub_embedder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedding of at most 256 places: signs of hashed words, of length 1."""
    known: dict[str, int] = {}

    def place(word: str) -> int:
        """The word's place, or that and size for a negative sign."""
        digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
        known[word] = digest[0] % size + (0 if digest[1] < 128 else size)
        return known[word]

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            if len(known) > KNOWN_WORDS:
                known.clear()
            codes = [known[w] if w in known else place(w) for w in text.lower().split()]
            counts = np.bincount(np.array(codes, dtype=np.int64), minlength=2 * size)
            out[i] = counts[:size] - counts[size:]
            out[i] /= np.linalg.norm(out[i]) or 1.0
        return out

    return embed


def embedded_in_place(chunks: DataFrame, provider: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text") -> DataFrame:
    """chunks (…, text) with v in place of the text, from a provider that is made once a task and asked once for equal texts of a slice.

    No text is shuffled. Where calls cost more than moving the texts, embedded asks once for equal texts of all chunks. A
    null text has no vector.
    """
    kept = [c for c in chunks.columns if c != text]
    schema = T.StructType([*[chunks.schema[c] for c in kept], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches):
        embed = provider()
        for batch in sliced(batches):
            texts = batch.column(len(kept)).dictionary_encode()
            found = np.asarray(embed(texts.dictionary.to_pylist()), dtype=np.float64)
            own = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64())) if len(found) else pa.nulls(0, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], own.take(texts.indices)], names=[*kept, "v"])

    return chunks.select(*kept, text).mapInArrow(run, schema)


def embedded(chunks: DataFrame, cache: DataFrame | None, provider: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(id, key, v) of chunks (id, text): from the cache (key, v) where the text's hash is known, else from the provider.

    The cache's key is the content, so a changed text is never given an old vector. The provider is made once a task.
    """
    keyed = chunks.select("id", "text", F.sha2("text", 256).alias("key"))

    def run(batches):
        embed = provider()
        for df in batches:
            yield pd.DataFrame({"key": df["key"], "v": list(embed(df["text"].tolist()))})

    wanted = keyed.groupBy("key").agg(F.first("text").alias("text"))
    if cache is not None:
        wanted = wanted.join(cache.select("key"), "key", "left_anti")
    new = wanted.mapInPandas(run, "key string, v array<double>")
    vectors = new if cache is None else cache.select("key", "v").unionByName(new)
    return keyed.drop("text").join(vectors, "key").select("id", "key", "v")
