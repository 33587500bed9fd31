"""Exact vector search: the best rows of each query by cosine, and the place of one row in a query's order.

Few queries are sent to all tasks, behind a check of their size. Many meet the vectors in tiles: both sides are cut by a
hash into tiles of bounded size, each pair of tiles is a group of one shuffle, and a task holds one tile of queries and a
slice of vectors. So the plan is the same whatever the number of queries, and nothing passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import durable, small

#: Queries whose vectors hold at most so many numbers (8 MB) are broadcast; the numbers of a tile.
FEW_VALUES = TILE_VALUES = 1 << 20
#: Scores that a task holds at once.
_SCORES = 1 << 21


def ranked(scored: DataFrame, k: int, group: str = "qid", order: list[Column] | None = None) -> DataFrame:
    """The k best rows of each group with their rank; Spark prunes to k a group before it shuffles."""
    best = Window.partitionBy(group).orderBy(*(order or [F.desc(F.round("score", 9)), F.col("ord")]))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(ids: pa.Array, v: pa.Array):
    """(length, rows, unit vectors) of the non-zero vectors of each length among v; rows are those of ids with one."""
    sizes = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero((sizes == n) & np.asarray(ids.is_valid()))
        x = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
        good = np.linalg.norm(x, axis=1) > 0
        if good.any():
            yield int(n), rows[good], units(x[good])


class Best:
    """For each query the k best of the scores seen, to nine digits; of equal ones those with the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.keys, self.scores = np.full((queries, k), -np.inf), np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: queries x rows, the rows having these ids. Rows below the k-th score of what is held are left at once."""
        keys, least = np.round(scores, 9), self.keys[:, -1]
        if keys.shape[1] > self.k:
            least = np.maximum(least, np.partition(keys, -self.k, axis=1)[:, -self.k])
        q, row = np.nonzero((keys >= least[:, None]) & (keys > -np.inf))
        if not len(q):
            return
        all_q = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), q])
        all_keys, all_ids = np.concatenate([self.keys.ravel(), keys[q, row]]), np.concatenate([self.ids.ravel(), ids[row]])
        order = np.lexsort((all_ids, -all_keys, all_q))
        first = np.searchsorted(all_q[order], np.arange(len(self.ids)))
        order = order[first[:, None] + np.arange(self.k)]
        self.keys, self.ids, self.scores = all_keys[order], all_ids[order], np.concatenate([self.scores.ravel(), scores[q, row]])[order]

    def rows(self, qids: np.ndarray) -> pa.RecordBatch:
        q, place = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), pa.array(self.ids[q, place], pa.int64()), pa.array(self.scores[q, place])], names=["qid", "chunk_id", "score"])


class _TopK:
    """Queries of one length against slices of rows: the k best of each."""

    schema = "qid long, chunk_id long, score double"

    def __init__(self, qids: np.ndarray, q: np.ndarray, extra: list, k: int, skip_own: bool) -> None:
        self.qids, self.q, self.best, self.skip_own = qids, q, Best(len(qids), k), skip_own

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(16, _SCORES // max(1, len(self.q)))
        for i in range(0, len(ids), step):
            scores = self.q @ x[i : i + step].T
            if self.skip_own:
                scores[self.qids[:, None] == ids[None, i : i + step]] = -np.inf
            self.best.add(scores, ids[i : i + step])

    def result(self) -> pa.RecordBatch:
        return self.best.rows(self.qids)


class _Above:
    """Queries of one length, each with a target row (id, vector): how many rows score above it."""

    schema = "qid long, chunk_id long, n long"

    def __init__(self, qids: np.ndarray, q: np.ndarray, extra: list) -> None:
        self.qids, self.q, self.wanted = qids, q, [r["chunk_id"] for r in extra]
        self.mine = np.round((q * units(np.array([r["target"] for r in extra], dtype=np.float64))).sum(axis=1), 9)
        self.count = np.zeros(len(qids), dtype=np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(16, _SCORES // max(1, len(self.q)))
        for i in range(0, len(ids), step):
            self.count += (np.round(self.q @ x[i : i + step].T, 9) > self.mine[:, None]).sum(axis=1)

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.qids, pa.int64()), pa.array(self.wanted, pa.int64()), pa.array(self.count)], names=["qid", "chunk_id", "n"])


def _asked(batches: list[pa.RecordBatch], work) -> dict[int, object]:
    """work(qids, unit vectors, extra) for each length of the queries (id, v, extra) in batches."""
    if not batches:
        return {}
    whole = pa.Table.from_batches(batches).combine_chunks()
    ids, v, extra = (whole.column(i).combine_chunks() if whole.num_rows else None for i in range(3))
    if ids is None:
        return {}
    ids, v, extra = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, v, extra))
    numbers = ids.to_numpy(zero_copy_only=False)
    return {n: work(numbers[rows], x, extra.take(pa.array(rows)).to_pylist()) for n, rows, x in by_length(ids, v)}


def _meet(held: dict[int, object], ids: pa.Array, v: pa.Array) -> None:
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n, rows, x in by_length(ids, v):
        if n in held:
            held[n].add(numbers[rows], x)


def _plain(df: DataFrame, key: str, extra: Column | None = None) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), (F.lit(None).cast("struct<chunk_id:bigint,target:array<double>>") if extra is None else extra).alias("extra"))


def _size(df: DataFrame) -> tuple[int, int]:
    """(rows, numbers of the longest vector)."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    return row["n"], max(1, row["d"])


def _met(asked: DataFrame, rows: DataFrame, work, schema: str, few: int) -> DataFrame:
    """Results of work over asked (id, v, extra) and rows (id, v), a part for each task that meets a query."""
    n, d = _size(asked)
    if n * d <= few:
        block = asked.toArrow()  # at most `few` numbers
        shared = asked.sparkSession.sparkContext.broadcast(block.combine_chunks().to_batches())

        def scan(batches):
            held = _asked(shared.value, work)
            for batch in batches:
                _meet(held, batch.column(0), batch.column(1))
            for w in held.values():
                yield w.result()

        return rows.select("id", "v").mapInArrow(scan, schema)
    m, e = _size(rows)
    left, right = (max(1, -(-r * c // TILE_VALUES)) for r, c in ((n, d), (m, e)))
    right = max(right, -(-asked.sparkSession.sparkContext.defaultParallelism // left))
    every = lambda t: F.explode(F.sequence(F.lit(0), F.lit(t - 1)))
    own = lambda t: F.pmod(F.xxhash64("id", F.lit(19)), F.lit(t)).cast("int")
    asks = asked.select(own(left).alias("a"), every(right).alias("b"), F.lit(False).alias("right"), "id", "v", "extra")
    both = asks.union(rows.select(every(left).alias("a"), own(right).alias("b"), F.lit(True).alias("right"), "id", "v", F.lit(None).cast("struct<chunk_id:bigint,target:array<double>>")))

    def tiles(batches):
        key, waiting, held = None, [], None
        for batch in batches:
            a, b, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])) + 1 if batch.num_rows else []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if (a[lo], b[lo]) != key:
                    for w in (held or {}).values():
                        yield w.result()
                    key, waiting, held = (a[lo], b[lo]), [], None
                part = batch.slice(lo, hi - lo).select(["id", "v", "extra"])
                if not side[lo]:
                    waiting.append(part)
                    continue
                if held is None:
                    held, waiting = _asked(waiting, work), []
                _meet(held, part.column(0), part.column(1))
        for w in (held or {}).values():
            yield w.result()

    return both.repartition("a", "b").sortWithinPartitions("a", "b", "right", "id").mapInArrow(tiles, schema)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, skip_own: bool = False, few: int = FEW_VALUES) -> DataFrame:
    """Rows (qid, chunk_id, score, rank): the k vectors (chunk_id, v) of highest cosine similarity for each query (qid, v).

    Exact. A query meets the vectors of its own length; zero vectors and null ids take no part; ties go to the smaller
    chunk_id; with skip_own, the vector with the query's own id is left out. Queries of at most `few` numbers are sent to
    the vectors' tasks; beyond, both meet in tiles.
    """
    found = _met(_plain(queries, "qid"), _plain(vectors, "chunk_id"), lambda ids, q, extra: _TopK(ids, q, extra, k, skip_own), _TopK.schema, few)
    return ranked(found, k, order=[F.desc(F.round("score", 9)), F.col("chunk_id")])


def knn_graph(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Rows (qid, chunk_id, score, rank): the k nearest other vectors of each vector (chunk_id, v), in tiles."""
    return vector_topk(vectors.select(F.col("chunk_id").alias("qid"), "v"), vectors, k, skip_own=True, few=0)


def rank_of(queries: DataFrame, vectors: DataFrame, wanted: DataFrame, few: int = FEW_VALUES) -> DataFrame:
    """(qid, chunk_id, position): the place of one wanted chunk (qid, chunk_id) in the query's full ordering by cosine, from 1."""
    own = vectors.select(F.col("chunk_id").alias("_c"), F.col("v").alias("_t"))
    asked = durable(own.join(small(wanted.join(queries.select("qid", "v"), "qid")), F.col("chunk_id") == F.col("_c")))
    target = F.struct(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("_t").cast("array<double>").alias("target"))
    same = F.size("v") == F.size("_t")
    found = _met(_plain(asked.where(same), "qid", target), _plain(vectors, "chunk_id"), _Above, _Above.schema, few)
    return found.groupBy("qid", "chunk_id").agg((F.sum("n") + 1).alias("position"))
