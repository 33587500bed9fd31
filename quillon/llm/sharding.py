"""Sharding by longest-processing-time scheduling of groups that must stay together.

A group's size is the sum of its members' sizes. Groups of one size are a class: the driver gets each class's size and
count, and places the classes from the largest size down on the least-loaded shards. A class of few groups goes through
the heap group by group; one of many is poured in at once, which gives the counts that the heap would give. So every
group is scheduled by its own size, and the driver holds one number a class and shard. Sizes of n bytes in all have at
most sqrt(2 n) different values; each shard's groups of a class are a range of the class's groups in hash order.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, running_start, small

#: Classes of more groups than this are poured in at once.
HEAP_GROUPS = 64


def schedule(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of each key: the largest size first, to the least-loaded shard; ties go to the smaller key and shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[key] = shard
    return placed


def poured(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of `count` groups of one positive size each shard gets from the heap, given its load.

    The heap takes the `count` smallest of all loads that a shard passes through; ties go to the smaller shard.
    """
    lo, hi = int(loads.min()) - 1, int(loads.min()) + size * count  # the last level at which at most `count` are taken
    while lo < hi:
        level = (lo + hi + 1) // 2
        if int(np.maximum(0, (level - loads) // size + 1).sum()) <= count:
            lo = level
        else:
            hi = level - 1
    taken = np.maximum(0, (lo - loads) // size + 1)
    next_up = np.flatnonzero(loads + taken * size == lo + 1)
    taken[next_up[: count - int(taken.sum())]] += 1
    return taken


def schedule_classes(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """Groups by (class, shard) of classes with the given sizes, descending, and counts of groups; as schedule would place them."""
    out = np.zeros((len(sizes), shards), dtype=np.int64)
    loads = np.zeros(shards, dtype=np.int64)
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if count > HEAP_GROUPS and size > 0:
            out[i] = poured(loads, size, count)
        else:
            heap = [(load, s) for s, load in enumerate(loads.tolist())]
            heapq.heapify(heap)
            for _ in range(count):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                out[i, shard] += 1
        loads += out[i] * size
    return out


def assign_shards(rows: DataFrame, group: str, size: str, shards: int) -> DataFrame:
    """rows with `shard` (int): rows of equal `group` (not null) share a shard, loads of `size` (0 or more) are near equal."""
    spark = rows.sparkSession
    groups = checkpointed(rows.groupBy(F.col(group).alias("_group")).agg(F.sum(size).cast("long").alias("_size")).withColumn("_one", F.lit(1).cast("long")))
    classes = groups.groupBy("_size").agg(F.count("*").alias("n")).toPandas().sort_values("_size", ascending=False)  # one row a size
    sizes, counts = classes["_size"].to_numpy(dtype=np.int64), classes["n"].to_numpy(dtype=np.int64)
    ends = np.cumsum(schedule_classes(sizes, counts, shards), axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * shards, pa.int32()), pa.array(ends.ravel()))
    table = checkpointed(spark.createDataFrame(pa.table({"_of": pa.array(sizes), "_ends": lists})))
    ranked = running_start(groups, ["_size"], ["_group"], "_one", "_rank")
    placed = ranked.join(small(table, 100_000), F.col("_size") == F.col("_of"))
    shard = F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int")
    placed = checkpointed(placed.select("_group", shard.alias("shard")))  # of its own, so that the join can be split
    return rows.join(placed, F.col(group) == F.col("_group")).drop("_group")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text).

    Documents with equal texts stay together; a null text counts as empty and its size is 8. Law `bytes`: loads are those
    of longest-processing-time scheduling of all groups, so they differ by one of the smallest groups at the end unless a
    group alone is larger than its share, in which case that group has a shard to itself as far as the heap allows. slot
    numbers a shard's documents from 0 without a gap. Rows with a null or repeated doc_id are documents of their own. An
    empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = checkpointed(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("_digest"),
        )
    )
    placed = assign_shards(rows, "_digest", "size", shards).drop("_digest").withColumn("_one", F.lit(1).cast("long"))
    numbered = running_start(placed, ["shard"], ["doc_id", "size", "text_crc32"], "_one", "slot", buckets=256)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
