"""Shared helpers: cutting lineage in the shared folder, size-checked joins, connected components, prefix sums."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.session import removed, shared_folder

#: A side of at most so many narrow rows (an id and a few numbers, under 64 bytes each) may be broadcast.
BROADCAST_ROWS = 500_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names, so that lost executors cost no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts; where fewer files than cores hold it, it is dealt out to all cores first."""
    df, cores = read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if len(df._jdf.inputFiles()) >= cores else df.repartition(cores)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its measured row count is within `rows`; else df as it is, for a shuffled join.

    df must be narrow and cheap to count (a checkpoint).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: The minima of so few edges, at most two rows of 16 bytes for each, 8 MB, are broadcast.
FEW_EDGES = 1 << 18
#: About so many edges a task, where they are few.
TASK_EDGES = 1 << 17


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b: long), cheap to read twice, as rows (node, component): the smallest node reachable.

    Alternates large-star and small-star steps on shuffled edges, so no component is gathered in one task; minima are
    combined before each shuffle. Up to FEW_EDGES they are broadcast; beyond, they are checkpointed, so that the joins with
    them can be split where a node has many edges. Each round is checkpointed. The smallest node of a component gets no row, nor do nodes
    without a link to another.
    """
    few = (n := links.count()) <= FEW_EDGES

    def narrow(df: DataFrame) -> DataFrame:
        return df.coalesce(max(2, -(-n // TASK_EDGES))) if few else df

    pairs = narrow(links).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    edges = checkpointed(narrow(pairs.distinct()))
    now, seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v"))).first(), None
    while now != seen:
        own, sent = ((lambda df: df), F.broadcast) if few else (checkpointed, checkpointed)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sent(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = own(large.distinct())
        least = sent(edges.groupBy("u").agg(F.min("v").alias("m")))
        joined = edges.join(least, "u")
        edges = joined.select("v", "m").where("v != m").union(joined.select("u", "m")).toDF("u", "v").distinct()
        edges = checkpointed(narrow(edges))
        now, seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v"))).first(), now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def running_start(df: DataFrame, group: list[str], order: list[str], amount: str, name: str, buckets: int = 1024) -> DataFrame:
    """Adds `name`: the sum of `amount` over the rows of the same group that come before, by hash of `order`, then `order`.

    A group is cut into `buckets` ranges of the hash. Only the ranges' totals, at most `buckets` rows a group, are summed
    in one place; rows are ranked within their range, so a group with a third of all rows is spread over many tasks.
    """
    hashed = df.withColumn("_h", F.xxhash64(*order, F.lit(7))).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)).cast("int"))
    totals = hashed.groupBy(*group, "_b").agg(F.sum(amount).alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = hashed.withColumn("_r", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = F.lit(True)
    other = starts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_b2"), "_s")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        ranked.join(other, same & (F.col("_b") == F.col("_b2")))
        .withColumn(name, F.col("_s") + F.col("_r"))
        .drop("_h", "_b", "_r", "_s", "_b2", *[f"_g{i}" for i in range(len(group))])
    )


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and its path; for tables with texts."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bits of a filter at most: 8 MB, whatever the input. A full filter lets more through, which costs time only.
FILTER_BITS = 1 << 26
PROBES = 4


def filter_size(keys: int, bits: int = FILTER_BITS) -> int:
    """A power of two, at least 16 bits a key and 32768, at most `bits`."""
    size = 1 << 15
    while size < min(bits, 16 * keys):
        size *= 2
    return size


def filter_bits(places: DataFrame, size: int) -> bytes:
    """A bitmap of `size` bits with those set that column p of places names; built in Spark, 4 KB for each row returned."""
    parts = places.groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    found = np.zeros((size >> 15, 4096), dtype=np.uint8)
    for r in parts:
        found[r["part"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return found.tobytes()


def id_filter(ids: DataFrame) -> bytes:
    """A Bloom filter over column id (long, not null) of ids, which must be cheap to read twice."""
    size = filter_size(ids.count())
    text = F.col("id").cast("string")
    h, g = F.crc32(text.cast("binary")), F.crc32(F.concat(F.lit("g"), text).cast("binary"))
    return filter_bits(ids.select(F.explode(F.array(*[F.pmod(h + g * F.lit(i), F.lit(size)) for i in range(PROBES)])).alias("p")), size)


def may_hold(bits: bytes, ids: list[int | None]) -> np.ndarray:
    """Which of the ids the filter may hold; null is never held."""
    size, out = len(bits) * 8, np.zeros(len(ids), dtype=bool)
    for n, i in enumerate(ids):
        if i is not None:
            text = b"%d" % i
            h, g = zlib.crc32(text), zlib.crc32(b"g" + text)
            out[n] = all(bits[(p := (h + k * g) % size) >> 3] >> (p & 7) & 1 for k in range(PROBES))
    return out


def sliced(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
