"""Hard-negative mining over inverted lists of K-means clusters with stored radii.

Scores are inner products. For a cluster with centroid c and radius r, the largest distance of a member from c, and an
anchor a, the Cauchy-Schwarz inequality puts every member's score between a.c - |a|r and a.c + |a|r. An anchor visits the
clusters in falling order of the upper bound and stops where the bound lies strictly below the k-th score that it holds;
at an equal bound a member may still win by its smaller id. Negatives must lie in a window of scores, so clusters whose
bounds miss the window are skipped as well.

On Spark, an anchor's visits are made in rounds: each round sends it to its next clusters, four times as many as in the
round before, and raises its k-th score, until no anchor has a cluster left to visit. The clusters' centroids and radii
are a table of bounded size (MAX_CLUSTERS) that is broadcast; lists are cut into blocks of at most BLOCK_ROWS rows of one
label, so a cluster that holds a third of all rows is many blocks, and no task holds more than one block and a slice of
the anchors that asked for it. Blocks keep radii of their own, which spares anchors a block of a visited cluster.

Of rows with equal vectors and labels only the first few by id can be among the first few of any anchor, since their
scores are equal; the others are left out of the lists (an exact rule, not a cap).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed

SAMPLE_ROWS = 20_000
MAX_CLUSTERS = 1024
BLOCK_ROWS = 4096
FIRST_VISITS = 8
_LEAST, _MOST = -(1 << 62), 1 << 62
#: Sums of products below this are exact in double precision.
_EXACT = 2.0**53


def relabelled(vec_id: Column, label: Column) -> Column:
    """The label, or where vec_id is divisible by 7, (label + 1) % 10."""
    return F.when(F.pmod(vec_id, F.lit(7)) == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)


def usable_rows(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v: array<double>) that take part, with whole components floor(256 x).

    Rows with a null vec_id, label or vector, an empty vector, a null or non-finite component, or another number of
    components than the commonest (of two that tie, the smaller) take no part.
    """
    v = F.col("embedding").cast("array<double>")
    good = F.expr("vec_id is not null and label is not null and size(v) > 0") & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).where(good)
    usual = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    held = held.where(F.size("v") == (usual["d"] if usual else 0))
    # From 2^53 on all doubles are whole; floor() gives a long, which larger ones would overflow.
    whole = F.transform("v", lambda x: F.when(F.abs(x * 256) < _EXACT, F.floor(x * 256).cast("double")).otherwise(x * 256))
    return held.select("vec_id", relabelled(F.col("vec_id"), F.col("label")).alias("label"), whole.alias("v"))


def distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal label and vector, the k with the smallest ids; Spark prunes before it shuffles."""
    first = Window.partitionBy("label", "v").orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centroids of about k clusters of the rows of x; empty clusters are dropped."""
    rng = np.random.default_rng(seed)
    centroids = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        own = nearest(x, centroids)
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centroids = sums / np.diff(np.r_[first, len(x)])[:, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, rows: int = 4096) -> np.ndarray:
    """For each row of x the number of the nearest centroid."""
    half = 0.5 * np.square(centroids).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + rows] @ centroids.T - half, axis=1) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0, dtype=np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b, which hold whole numbers, as int64; beyond it, the nearest that fits."""
    if np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b).T), _LEAST, _MOST).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def inverted_lists(rows: DataFrame, centroids: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (vec_id, label, v) with their cluster, its distance, and the block of their list: rows of one cluster and label.

    A list is cut by a hash of the row into parts of half a block's size on average, so few blocks are longer than that.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(2))
            own = nearest(x, shared.value)
            # A little more than the rounded distance, so that the bound holds.
            far = np.sqrt(np.square(x - shared.value[own]).sum(axis=1)) * (1 + 1e-9) + 1e-6
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far)], names=["vec_id", "label", "v", "cluster", "far"])

    placed = checkpointed(rows.select("vec_id", "label", "v").mapInArrow(assign, "vec_id long, label long, v array<double>, cluster int, far double"))
    sizes = placed.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    parts = sizes.select(F.col("cluster").alias("_c"), F.col("label").alias("_l"), F.ceil(F.col("n") * 2 / block_rows).cast("int").alias("_parts"))
    joined = placed.join(parts, (F.col("cluster") == F.col("_c")) & (F.col("label") == F.col("_l")))
    part = F.pmod(F.xxhash64("vec_id", "v", F.lit(5)), F.col("_parts")).cast("int")
    return joined.select("vec_id", "label", "v", "cluster", "far", part.alias("part"))


class Directory:
    """What every task knows of the lists: centroids and radii, a bounded table."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray) -> None:
        self.centroids, self.radii = centroids, radii

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of the rows of a in each cluster (anchors x clusters)."""
        middle, spread = a @ self.centroids.T, np.sqrt(np.square(a).sum(axis=1))[:, None] * self.radii
        # Rounding must not turn a bound into one that a score exceeds.
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6
        return middle - spread - slack, middle + spread + slack

    def visits(self, a: np.ndarray, since: int, upto: int, low: np.ndarray, high: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(visits, left): which clusters each row of a visits now, and whether it may have more later.

        Clusters are ranked by falling upper bound, a tie by their number; those ranked from `since` to before `upto` are
        in turn. low, high and kth (anchors x windows) are each window's bounds and its k-th score so far; a cluster is
        of use to a window that its bounds meet unless its upper bound lies strictly below the k-th score.
        """
        under, over = self.bounds(a)
        rank = np.empty_like(under, dtype=np.int64)
        np.put_along_axis(rank, np.argsort(-over, axis=1, kind="stable"), np.arange(under.shape[1])[None, :], axis=1)
        useful = np.zeros(under.shape, dtype=bool)
        for j in range(low.shape[1]):
            useful |= (over >= np.maximum(low[:, j], kth[:, j])[:, None]) & (under <= high[:, j][:, None]) & (low[:, j] <= high[:, j])[:, None]
        return useful & (rank >= since) & (rank < upto), (useful & (rank >= upto)).any(axis=1)


def first_in_windows(scores: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, found), each (anchors x k): the columns of the k highest scores within [low, high], the smaller column first."""
    held = np.where((scores >= low[:, None]) & (scores <= high[:, None]), scores, _LEAST - 1)
    rows, columns, found = np.arange(len(scores)), [], []
    for _ in range(min(k, scores.shape[1])):
        best = held.argmax(axis=1)
        found.append(held[rows, best] >= _LEAST)
        columns.append(best)
        held[rows, best] = _LEAST - 1
    return np.stack(columns, axis=1), np.stack(found, axis=1)


def _scan(k: int, slice_rows: int = 32):
    """Batches of blocks' rows, each block's list before the anchors that ask for it, to (anchor, window, vec_id, score)."""

    def run(batches):
        at, ids, vectors, far, ready = None, [], [], [], None
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = [columns[n].to_numpy(zero_copy_only=False) for n in ("cluster", "label", "part", "asks")]
            vec_id, radius = columns["vec_id"].to_numpy(zero_copy_only=False), columns["far"].to_numpy(zero_copy_only=False)
            x = _matrix(columns["v"])
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if batch.num_rows else []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                key = tuple(int(k[lo]) for k in keys[:3])
                if key != at:
                    at, ids, vectors, far, ready = key, [], [], [], None
                if not keys[3][lo]:
                    ids.append(vec_id[lo:hi])
                    vectors.append(x[lo:hi])
                    far.append(radius[lo:hi])
                    continue
                if ready is None:
                    if not ids:
                        continue
                    order = np.argsort(np.concatenate(ids), kind="stable")
                    ready = np.concatenate(ids)[order], np.concatenate(vectors)[order], max(f.max() for f in far)
                for start in range(lo, hi, slice_rows):
                    stop = min(hi, start + slice_rows)
                    windows = [_matrix(columns[n].slice(start, stop - start)) for n in ("low", "high", "kth")]
                    yield _answers(ready, vec_id[start:stop], x[start:stop], _matrix(columns["centre"].slice(start, stop - start)), windows, k)

    def _answers(ready, anchors, a, centre, windows, k):
        ids, vectors, radius = ready
        low, high, kth = windows
        least = np.maximum(low, kth)
        # The block's own bound: centre is (a.c, |a|).
        reach = centre[:, 0] + centre[:, 1] * radius
        reach += 1e-9 * np.abs(reach) + 1e-6
        keep = np.flatnonzero((reach[:, None] >= least).any(axis=1))
        rows: list[list] = [[], [], [], []]
        if len(keep):
            scores = products(a[keep], vectors)
            scores[anchors[keep][:, None] == ids[None, :]] = _LEAST - 1
            for j in range(low.shape[1]):
                columns, found = first_in_windows(scores, least[keep, j].astype(np.int64), high[keep, j].astype(np.int64), k)
                i, p = np.nonzero(found)
                at = columns[i, p]
                for held, values in zip(rows, (anchors[keep][i], np.full(len(i), j), ids[at], scores[i, at]), strict=True):
                    held.append(values)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        arrays = [pa.array(np.concatenate(v) if v else np.zeros(0, dtype=np.int64), kind) for v, kind in zip(rows, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["anchor_id", "window", "vec_id", "score"])

    return run


def searched(anchors: DataFrame, lists: DataFrame, shared, clusters: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, window, rank, vec_id, score): each anchor's first k rows in each window, of its own label or of the others.

    anchors: (anchor_id, label, v, low, high: arrays of the windows' bounds). Exact. The k-th scores so far travel with the
    anchors, an array of a few numbers each.
    """
    sizes = anchors.select("anchor_id", "label", "v", "low", "high")
    blocks = checkpointed(lists.groupBy("cluster", "label", "part").agg(F.max("far").alias("far")))
    listed = lists.select("cluster", "label", "part", F.lit(False).alias("asks"), "vec_id", "far", "v", *[F.array().cast("array<double>").alias(n) for n in ("low", "high", "kth", "centre")])
    best, since, step = None, 0, FIRST_VISITS
    while True:
        upto = min(clusters, since + step)
        last = upto >= clusters
        held = sizes if best is None else sizes.join(_kth(best, k), "anchor_id", "left")
        kth = F.transform("low", lambda x: F.lit(float(_LEAST)))
        if best is not None:
            kth = F.transform("low", lambda x, i: F.coalesce(F.try_element_at("kth", i), F.lit(float(_LEAST))))
        routed = checkpointed(held.select("anchor_id", "label", "v", "low", "high", kth.alias("kth")).mapInArrow(_router(shared, since, upto), "anchor_id long, label long, v array<double>, low array<double>, high array<double>, kth array<double>, cluster int, centre array<double>, more boolean"))
        mine = F.col("label") == F.col("_label") if same else F.col("label") != F.col("_label")
        asks = routed.where("cluster is not null").withColumnRenamed("label", "_label").join(blocks.drop("far"), "cluster").where(mine)
        asks = asks.select("cluster", "label", "part", F.lit(True).alias("asks"), F.col("anchor_id").alias("vec_id"), F.lit(0.0).alias("far"), "v", "low", "high", "kth", "centre")
        met = F.broadcast(routed.where("cluster is not null").select("cluster").distinct())  # at most MAX_CLUSTERS rows
        both = listed.join(met, "cluster", "left_semi").union(asks).repartition("cluster", "label", "part").sortWithinPartitions("cluster", "label", "part", "asks", "vec_id")
        found = both.mapInArrow(_scan(k), "anchor_id long, window int, vec_id long, score long")
        found = found if best is None else found.union(best.select("anchor_id", "window", "vec_id", "score"))
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        best = checkpointed(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if last or routed.where("more").isEmpty():
            return best.select("anchor_id", "window", "rank", "vec_id", "score")
        # Anchors without a further cluster of use take no part in the next round.
        sizes = sizes.join(routed.where("more").select("anchor_id").distinct(), "anchor_id", "left_semi")
        since, step = upto, 4 * step


def _kth(best: DataFrame, k: int) -> DataFrame:
    """(anchor_id, kth: map window -> the k-th score) of the windows that are full."""
    full = best.where(F.col("rank") == k).select("anchor_id", F.struct(F.col("window").alias("k"), F.col("score").cast("double").alias("v")).alias("e"))
    return full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list("e")).alias("kth"))  # a row a window


def _router(shared, since: int, upto: int):
    """Batches of anchors to a row for each cluster that an anchor visits now; one with a null cluster for one that visits none."""

    def run(batches):
        directory = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            a = _matrix(batch.column(2))
            low, high, kth = (_matrix(batch.column(i)) for i in (3, 4, 5))
            visits, more = directory.visits(a, since, upto, low, high, kth)
            size = np.sqrt(np.square(a).sum(axis=1))
            for start in range(0, batch.num_rows, 256):
                own = visits[start : start + 256]
                row, cluster = np.nonzero(own)
                row += start
                idle = start + np.flatnonzero(~own.any(axis=1))
                rows, clusters = np.r_[row, idle], np.r_[cluster, np.zeros(len(idle), dtype=np.int64)]
                none = np.r_[np.zeros(len(row), dtype=bool), np.ones(len(idle), dtype=bool)]
                centre = np.stack([(a[rows] * directory.centroids[clusters]).sum(axis=1), size[rows]], axis=1)
                taken = batch.take(pa.array(rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(rows) + 1, 2), pa.int32()), pa.array(centre.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(clusters, pa.int32(), mask=none), lists, pa.array(more[rows])],
                    names=["anchor_id", "label", "v", "low", "high", "kth", "cluster", "centre", "more"],
                )

    return run


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    rows has vec_id, label and embedding; other columns are ignored (see usable_rows for rows that take no part, and
    relabelled for the labels). Anchors are the rows whose vec_id is divisible by `every`; of rows that share such a
    vec_id the one with the smallest label and vector asks. An anchor's positives are its first rows of the same label and
    another vec_id; a positive's negatives are the anchor's first rows of other labels whose score lies between `least`
    and `most` percent of the positive's. Order is by falling score, then vec_id. Rows that repeat a vec_id are
    candidates of their own, but equal rows are one. Scores beyond 2^53 in size are compared as doubles. An empty table gives no rows. Centroids are learned from about
    sample_rows rows; every row is in the lists.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usable = checkpointed(usable_rows(rows).distinct())
    n = usable.count()
    if not n:
        return spark.createDataFrame([], schema)
    share = int(min(1.0, sample_rows / n) * 1_000_000) + 1
    sample = usable.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < share).orderBy("vec_id", "label", "v").limit(2 * sample_rows).select("v").collect()
    sample = sample or usable.select("v").limit(1).collect()
    centroids = kmeans(np.array([r["v"] for r in sample], dtype=np.float64), int(max(1, min(MAX_CLUSTERS, np.sqrt(n) / 2))))
    lists = checkpointed(inverted_lists(distinct_enough(usable, positives + 1), centroids))
    radii = np.zeros(len(centroids))
    for r in lists.groupBy("cluster").agg(F.max("far").alias("far")).collect():  # at most MAX_CLUSTERS rows
        radii[r["cluster"]] = r["far"]
    shared = spark.sparkContext.broadcast(Directory(centroids, radii))

    asking = usable.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("r"))
    anchors = checkpointed(asking.select("anchor_id", "r.label", "r.v"))
    whole = anchors.select("*", F.array(F.lit(float(_LEAST))).alias("low"), F.array(F.lit(float(_MOST))).alias("high"))
    near = checkpointed(searched(whole, lists, shared, len(centroids), positives, same=True).select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # least * p <= 100 * s <= most * p, in whole numbers.
    score = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(score * least / 100), F.floor(score * most / 100)
    windows = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", low.cast("double").alias("low"), high.cast("double").alias("high")))).alias("w"))  # `positives` entries
    asked = anchors.join(windows, "anchor_id")

    def bounds(name: str, none: float) -> Column:
        """Every anchor has the same number of windows; those beyond its positives are empty."""
        return F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("w", i)[name], F.lit(none))).alias(name)

    asked = asked.select("anchor_id", "label", "v", bounds("low", float(_MOST)), bounds("high", float(_LEAST)))
    found = searched(checkpointed(asked), lists, shared, len(centroids), negatives, same=False)
    found = found.select("anchor_id", (F.col("window") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
