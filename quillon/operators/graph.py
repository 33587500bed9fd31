"""Approximate vector search over navigable small-world graphs, one for each cell of the vectors, built in tasks.

Vectors are dealt to cells by the nearest of some centres, which are learned on a bounded sample; a cell with more rows
than a graph may hold is dealt on by hash. In a graph each node is linked, both ways, to its nearest among the nodes that
were put in before it: the first nodes are far apart, so their links are the long ones, and later links are short. A node
keeps at most twice as many links as it makes, those to its nearest and, of the rest, those that no kept neighbour is
nearer to. A search keeps a beam of the best nodes seen and opens the best unopened one until all of them are open.

The graph is a table (cell, node, chunk_id, v, links): store it once with store_graph and search it as often as needed.
A query goes to the graphs of the `probes` cells whose centres are nearest, or to all; a task holds one graph at a time.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.vectors import ranked, units
from quillon.session import durable

#: Rows of a graph, about; links that a node makes; nodes that a search keeps; vectors from which centres are learned.
GRAPH_ROWS, LINKS, BEAM, SAMPLE_ROWS = 8192, 12, 64, 10_000
#: Centres at most, a table that is broadcast.
CENTRES = 1024
SCHEMA = "cell long, node int, chunk_id long, v array<float>, links array<int>"


def build(x: np.ndarray, links: int = LINKS) -> list[np.ndarray]:
    """The links of each row of x (unit vectors), put in one after the other; blocks of rows meet all rows before them."""
    near: list[list[int]] = [[] for _ in range(len(x))]
    for lo in range(0, len(x), 256):
        hi = min(len(x), lo + 256)
        scores = x[lo:hi] @ x[:hi].T
        scores[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = -np.inf
        k = min(links, hi)
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        for i in range(lo, hi):
            row = scores[i - lo, best[i - lo]]
            for j in best[i - lo][row > -np.inf].tolist():
                near[i].append(j)
                near[j].append(i)
    return [_kept(x, i, np.array(sorted(set(own)), dtype=np.int32), links) for i, own in enumerate(near)]


def _kept(x: np.ndarray, i: int, own: np.ndarray, links: int) -> np.ndarray:
    """At most 2 * links of the neighbours: the nearest, and others as long as no kept one is nearer to them than i is."""
    if len(own) <= 2 * links:
        return own
    scores = x[own] @ x[i]
    order = np.argsort(-scores, kind="stable")
    own, scores = own[order], scores[order]
    between = x[own] @ x[own].T
    kept = list(range(links))
    for j in range(links, len(own)):
        if len(kept) == 2 * links:
            break
        if (between[j, kept] < scores[j]).all():
            kept.append(j)
    return own[kept]


class Graph:
    """One cell's graph, ready to be searched."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, links: list[np.ndarray]) -> None:
        self.ids, self.x, self.links = ids, x, links
        # Besides the first node a few more, so that parts without a path from it are found.
        self.entries = np.unique(np.linspace(0, len(ids) - 1, num=min(len(ids), 8)).astype(int))
        self.read = 0

    def nearest(self, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best found, best first, ties to the smaller id."""
        beam, seen = max(beam, k), np.zeros(len(self.ids), dtype=bool)
        seen[self.entries] = True
        scores = self.x[self.entries] @ q
        self.read += len(self.entries)
        waiting = [(-s, int(n)) for s, n in zip(scores, self.entries, strict=True)]
        held = [(-s, n) for s, n in waiting]  # a heap, the worst first
        heapq.heapify(waiting)
        heapq.heapify(held)
        while waiting:
            far, node = heapq.heappop(waiting)
            if len(held) >= beam and -far < held[0][0]:
                break
            new = self.links[node]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            self.read += len(new)
            for s, n in zip((self.x[new] @ q).tolist(), new.tolist(), strict=True):
                if len(held) < beam:
                    heapq.heappush(held, (s, n))
                elif s > held[0][0]:
                    heapq.heapreplace(held, (s, n))
                else:
                    continue
                heapq.heappush(waiting, (-s, n))
        rows = np.array([n for _, n in held])
        exact = np.round(self.x[rows].astype(np.float64) @ q.astype(np.float64), 9)
        order = np.lexsort((self.ids[rows], -exact))[:k]
        return rows[order], exact[order]


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres of the unit vectors in the sample, by a few rounds of spherical K-means."""
    centres = sample[np.random.default_rng(3).permutation(len(sample))[:n]]
    for _ in range(6):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.stack([sample[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("v").cast("array<double>")
    rows = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), v.alias("v")).where("chunk_id is not null and v is not null")
    return rows.where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


def graph_table(vectors: DataFrame, graph_rows: int = GRAPH_ROWS, links: int = LINKS) -> tuple[DataFrame, np.ndarray]:
    """(cell, node, chunk_id, v, links) of vectors (chunk_id, v), and the cells' centres; cell = centre + part * CENTRES.

    Vectors that are null, zero or hold null or NaN components, and those of another length than the usual one, have no
    node. Repeated ids are nodes of their own.
    """
    rows = durable(_usable(vectors))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows, n = rows.where(F.size("v") == (sizes["d"] if sizes else 0)), sizes["count"] if sizes else 0
    if not n:
        return rows.sparkSession.createDataFrame([], SCHEMA), np.zeros((0, 1))
    chosen = F.pmod(F.xxhash64("chunk_id", F.lit(23)), F.lit(1_000_000)) < int(min(1.0, SAMPLE_ROWS / n) * 1_000_000) + 1
    sample = [r["v"] for r in rows.where(chosen).orderBy("chunk_id").limit(2 * SAMPLE_ROWS).collect()] or [rows.first()["v"]]
    centres = _centres(units(np.array(sample)), max(1, min(CENTRES, -(-n // graph_rows))))
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                own = np.argmax(x @ shared.value.T, axis=1)
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), batch.column(0), v], names=["cell", "chunk_id", "v"])

    dealt = durable(rows.mapInArrow(deal, "cell long, chunk_id long, v array<float>"))
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / graph_rows).alias("parts"))  # at most CENTRES rows
    dealt = dealt.join(F.broadcast(parts), "cell")
    part = F.pmod(F.xxhash64("chunk_id", F.lit(29)), F.col("parts"))
    dealt = dealt.select((F.col("cell") + part * CENTRES).alias("cell"), "chunk_id", "v")

    def link(batches):
        for cell, ids, x in _by_cell(batches):
            # In an order that has nothing to do with the ids, so that the first nodes are far apart.
            order = np.random.default_rng(5).permutation(len(ids))
            ids, x = ids[order], x[order]
            near = build(x, links)
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            ends = np.cumsum([0, *map(len, near)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(near), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), cell)), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids), v, flat], names=["cell", "node", "chunk_id", "v", "links"])

    return dealt.repartition("cell").sortWithinPartitions("cell", "chunk_id").mapInArrow(link, SCHEMA), centres


def _by_cell(batches):
    """(cell, ids, vectors) of each run of rows (cell, chunk_id, v) of one cell."""
    at, ids, vectors = None, [], []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(cells)) + 1 if batch.num_rows else []
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if lo == hi:
                continue
            if cells[lo] != at and ids:
                yield at, np.concatenate(ids), np.concatenate(vectors)
                ids, vectors = [], []
            at = cells[lo]
            ids.append(batch.column(1).slice(lo, hi - lo).to_numpy())
            vectors.append(batch.column(2).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1))
    if ids:
        yield at, np.concatenate(ids), np.concatenate(vectors)


def graph_topk(graph: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 5, beam: int = BEAM, probes: int | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best found for each query (qid, v) in the graphs of its nearest cells, or of all."""
    spark = queries.sparkSession
    if not len(centres):
        return spark.createDataFrame([], "qid long, chunk_id long, score double, rank int")
    shared, d = spark.sparkContext.broadcast(centres), centres.shape[1]
    asked = _usable(queries.select(F.col("qid").alias("chunk_id"), "v")).where(F.size("v") == d)

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                m = min(probes or len(shared.value), len(shared.value))
                near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :m]
                taken = np.repeat(x.astype(np.float32), m, axis=0)
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, taken.size + 1, d), pa.int32()), pa.array(taken.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int64()), pa.array(np.repeat(batch.column(0).to_numpy(), m)), v], names=["centre", "qid", "v"])

    routed = asked.mapInArrow(route, "centre long, qid long, v array<float>")
    cells = graph.groupBy("cell").agg(F.count("*").alias("_n")).select("cell", F.pmod("cell", F.lit(CENTRES)).alias("centre"))
    asks = routed.join(cells, "centre").select("cell", F.lit(True).alias("asks"), F.lit(0).alias("node"), F.col("qid").alias("chunk_id"), "v", F.array().cast("array<int>").alias("links"))
    both = graph.select("cell", F.lit(False).alias("asks"), "node", "chunk_id", "v", "links").union(asks)

    def search(batches):
        at, graph, parts = None, None, []
        for batch in batches:
            cell, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (asks[1:] != asks[:-1])) + 1 if batch.num_rows else []
            found: list[tuple] = []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if cell[lo] != at:
                    at, graph, parts = cell[lo], None, []
                rows = batch.slice(lo, hi - lo)
                ids, x = rows.column(3).to_numpy(), rows.column(4).flatten().to_numpy().reshape(hi - lo, -1)
                if not asks[lo]:
                    flat, sizes = rows.column(5).flatten().to_numpy(), rows.column(5).value_lengths().to_numpy()
                    parts.append((ids, x, np.split(flat, np.cumsum(sizes)[:-1])))
                    continue
                if graph is None and parts:
                    graph = Graph(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [n for p in parts for n in p[2]])
                for qid, q in zip(ids.tolist(), x, strict=True) if graph else ():
                    own, scores = graph.nearest(q, k, beam)
                    found += [(qid, int(graph.ids[n]), float(s)) for n, s in zip(own, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["qid", "chunk_id", "score"])

    hits = both.repartition("cell").sortWithinPartitions("cell", "asks", "node", "chunk_id").mapInArrow(search, "qid long, chunk_id long, score double")
    return ranked(hits, k, order=[F.desc(F.round("score", 9)), F.col("chunk_id")])


def ann_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, beam: int = BEAM, probes: int | None = None, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """graph_topk over a graph of the vectors that is built for these queries; see store_graph for more than one batch."""
    graph, centres = graph_table(vectors, graph_rows)
    return graph_topk(durable(graph), centres, queries, k, beam, probes)


def store_graph(vectors: DataFrame, path: str, graph_rows: int = GRAPH_ROWS) -> None:
    """Writes the graph of the vectors to path: the nodes, and the centres, written last."""
    graph, centres = graph_table(vectors, graph_rows)
    graph.write.mode("overwrite").parquet(f"{path}/nodes")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    vectors.sparkSession.createDataFrame(rows, "centre long, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def stored_ann_topk(spark, path: str, queries: DataFrame, k: int = 5, beam: int = BEAM, probes: int | None = None) -> DataFrame:
    """graph_topk over a stored graph."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("centre").collect()  # at most CENTRES rows
    return graph_topk(spark.read.parquet(f"{path}/nodes"), np.array([r["v"] for r in rows]).reshape(len(rows), -1), queries, k, beam, probes)
