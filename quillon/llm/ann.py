"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: principal directions and rotations that bring the projections close to their signs, learned on a bounded sample;
several rotations side by side lengthen the code. Codes are cut into substrings of PART_BITS bits, and each shard of the
vectors indexes each substring: a directory of the values that occur, with the rows that have each. Thresholds for the
substrings that add up, with one for each, to the radius and one make the pigeonhole: a code within the radius of the
query's is within its threshold in at least one substring, so probing every directory value that near retrieves every
code within the radius. The candidates' distances are then computed from the original vectors. Long substrings are what
makes probing prune: a random value of 16 bits lies within 37 % of its bits one time in ten, one of 256 bits one time in
two hundred.

Vectors are dealt evenly over shards, so equal vectors never meet in one bucket of the cluster. Every shard gets all
queries after its vectors, in batches, and gives k rows for each; no table of queries is held anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed

SAMPLE_ROWS = 10_000
SHARD_ROWS = 16_384
PART_BITS = 256
_WORDS = PART_BITS // 64


def _itq(x: np.ndarray, seed: int, rounds: int = 10) -> np.ndarray:
    """A rotation of the columns of x that brings them close to their signs."""
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ rotation >= 0, 1.0, -1.0).T @ x)
        rotation = (u @ vt).T
    return rotation


class Coder:
    """vectors -> codes (vectors x parts x words of 64 bits)."""

    def __init__(self, sample: np.ndarray, parts: int = 4, seed: int = 5) -> None:
        d = sample.shape[1]
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
        centred = sample - self.mean
        basis = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(d))[1][:, ::-1]
        bits, blocks = parts * PART_BITS, []
        while sum(b.shape[1] for b in blocks) < bits:
            blocks.append(basis @ _itq(centred @ basis, seed + len(blocks)) if len(sample) else basis)
        self.projection = np.concatenate(blocks, axis=1)[:, :bits]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.projection >= 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(len(x), -1, _WORDS)


def apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Numbers of bits in which the codes differ from one code; leading axis of codes kept."""
    return np.bitwise_count(codes ^ code).reshape(len(codes), -1).sum(axis=1, dtype=np.int64)


def thresholds(radius: int, parts: int) -> list[int]:
    """A bound for each part, so that bits that exceed all of them exceed the radius; -1 where a part needs no probe."""
    each, more = divmod(radius + 1, parts)
    return [each - 1 + (i < more) for i in range(parts)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of b from a, in double precision."""
    return np.sqrt(np.square(b - a).sum(axis=1))


class ShardIndex:
    """The multi-index of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.codes = coder(self.vectors)
        self.directory = []
        for i in range(self.codes.shape[1]):
            part = np.ascontiguousarray(self.codes[:, i])
            rows = np.lexsort(part.T)
            new = np.r_[True, (part[rows[1:]] != part[rows[:-1]]).any(axis=1)][: len(rows)]
            first = np.flatnonzero(new)
            self.directory.append((part[rows[first]], first, np.r_[first[1:], len(rows)], rows))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows under the directory values that the pigeonhole names, in order."""
        found = []
        for value, bound, (values, first, last, rows) in zip(code, thresholds(radius, len(code)), self.directory, strict=True):
            near = np.flatnonzero(apart(values, value) <= bound)
            size = (last - first)[near]
            starts = np.repeat(first[near] - np.cumsum(size) + size, size)
            found.append(rows[starts + np.arange(len(starts))])
        return np.unique(np.concatenate(found))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes at most `radius` bits from code."""
        found = self.probed(code, radius)
        return found[apart(self.codes[found], code) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, code: np.ndarray, k: int, radius: int) -> list[tuple[int, float]]:
        """The k nearest of the rows within the radius, which grows by half until there are k of them or all rows are."""
        bits = PART_BITS * len(code)
        while True:
            found = self.within(code, radius)
            found = found[self.ids[found] != query_id]
            if len(found) >= k or radius >= bits:
                break
            radius = min(bits, radius + max(1, radius // 2))
        far = distance(vector, self.vectors[found])
        best = np.lexsort((self.ids[found], far))[:k]
        return [(int(self.ids[found[i]]), float(far[i])) for i in best]


def calibrated_radius(coder: Coder, sample: np.ndarray, k: int, share: float = 0.95, queries: int = 200) -> int:
    """The smallest radius that holds `share` of the k nearest neighbours of `queries` sampled vectors in the sample.

    In the whole table, which is denser, neighbours are nearer.
    """
    codes, found = coder(sample), []
    for i in range(min(queries, len(sample))):
        far = distance(sample[i], sample)
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[: min(k, len(sample) - 1)]
        found.append(apart(codes[near], codes[i]))
    return int(np.quantile(np.concatenate(found), share, method="higher")) if found and len(found[0]) else codes.shape[1] * PART_BITS


def clean_vectors(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, v: array<double>) that take part: an id, and a non-zero vector of finite numbers of the usual length.

    The usual length is the commonest one, the smaller of two that tie; vectors of another length have no distance to these.
    """
    v = F.col("embedding").cast("array<double>")
    good = (
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows.select(F.col("vec_id").cast("long"), v.alias("v")).where(good)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def learned(held: DataFrame, n: int, k: int, parts: int, sample_rows: int) -> tuple[Coder, int]:
    """The coder and the radius, from about sample_rows of the n rows (vec_id, v)."""
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < F.lit(int(min(1.0, sample_rows / n) * 1_000_000) + 1)
    sample = np.array([r["v"] for r in held.where(chosen).orderBy("vec_id").limit(2 * sample_rows).select("v").collect()], dtype=np.float64)
    if not len(sample):
        sample = np.array([r["v"] for r in held.select("v").limit(sample_rows).collect()], dtype=np.float64)
    coder = Coder(sample, parts)
    return coder, calibrated_radius(coder, sample, k)


def nearest_neighbours(rows: DataFrame, every: int = 100, k: int = 10, parts: int = 4, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties to the smaller vec_id.

    rows has vec_id and embedding (array of numbers); other columns are ignored. Queries are the rows whose vec_id is
    divisible by `every`, candidates all rows but those with the query's own id; score is the Euclidean distance. Vectors
    that are null, zero, of another length than the usual one, or hold null or non-finite numbers take no part, nor do rows
    with a null vec_id. Rows that share a vec_id are candidates of their own; queries that do are one query, the row with
    the smallest vector. An empty table gives no rows. The codes are learned from about sample_rows rows.
    """
    spark = rows.sparkSession
    held = checkpointed(clean_vectors(rows))
    n = held.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(learned(held, n, k, parts, sample_rows))
    shards = max(-(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, n // 512), 1)
    dealt = held.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = held.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    ready = dealt.union(asked).repartition("shard").sortWithinPartitions("shard", "asks", "vec_id")
    found = ready.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int):
    """Batches (shard, asks, vec_id, v) in order, each shard's vectors before its queries, to rows (query_id, vec_id, score)."""

    def run(batches):
        coder, radius = shared.value
        at, index, ids, vectors = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, asks, vec_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if shard[lo] != at:
                    at, index, ids, vectors = shard[lo], None, [], []
                if not asks[lo]:
                    ids.append(vec_id[lo:hi])
                    vectors.append(v[lo:hi])
                    continue
                if index is None and ids:
                    index = ShardIndex(np.concatenate(ids), np.concatenate(vectors), coder)
                if index is not None:
                    for q, x, code in zip(vec_id[lo:hi], v[lo:hi], coder(v[lo:hi]), strict=True):
                        out += [(int(q), *found) for found in index.nearest(q, x, code, k, radius)]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    return run
