"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents form one stream of words, in hash order, cut into blocks of `block` words. A source's target is
a whole number of passes over its blocks and a rest: the blocks whose rank under a keyed permutation is below the quota,
the last of which is cut so that the target is met to the word. The blocks to draw, a count for each source and thus
exact, are dealt out to output shards by a tree: each node draws its left half's counts from the multivariate
hypergeometric law and leaves the rest to the right half. A shard's draws are disjoint ranges of the ranks, and
each has a keyed hash by which its shard is shuffled. `mixed_blocks` lays the drawn blocks out by shard and hash;
`mixed_documents` lays whole documents out by the shard and hash of their first block. Only sources' totals and shards'
counts are held by the driver; a document finds its own blocks from its place in the stream.
"""

from __future__ import annotations

import math
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, running_start, small

SHARDS = 16
SHARD_WORDS = 1 << 26  # a shard has about so many words at most; beyond SHARDS of them there are more shards
#: A shard is written by so many tasks, each with a range of its hashes.
RANGES = 64
SEGMENTS = "array<struct<pass:int,start:long,length:long,shard:int,sort:long>>"
_SIZE = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_SIZE)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> dict:
    """Target words of each source. Sources in code-point order, null last, get the repeating weights and share
    `share` times all words; a target stops at `limit` times its source's size and the excess is shared anew by weight."""
    order = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    size = dict(sizes)
    left, open_ = share * sum(size.values()), set(order)
    found = {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if each * weight[s] >= limit * size[s]}
        if not full:
            return found | {s: each * weight[s] for s in open_}
        for s in full:
            found[s] = limit * size[s]
            left -= found[s]
        open_ -= full
    return found


def splitting_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by (shard, source) that sum to `counts` by source, with equal totals by shard, to within one."""
    counts = np.asarray(counts, dtype=np.int64)
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    ends = [int(counts.sum()) * i // shards for i in range(shards + 1)]

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left, rest, want = np.zeros_like(have), int(have.sum()), ends[mid] - ends[lo]
        for i, n in enumerate(have):  # marginals, one source after the other
            rest -= int(n)
            left[i] = _hypergeometric(rng, int(n), rest, want)
            want -= int(left[i])
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, shards, counts)
    return out


#: From so many on, numpy's generator stops.
GENERATOR_LIMIT = 1_000_000_000
_DIGITS = Context(prec=50)
_HALF_LOG_2PI = Decimal("0.91893853320467274178032973640561763986139747363778")


def _log_factorial(n: int) -> Decimal:
    """To about 30 digits: small factors by themselves, then Stirling's series."""
    if n < 100:
        return _DIGITS.ln(Decimal(math.factorial(n)))
    x = Decimal(n)
    tail, power = Decimal(0), x
    for num, den in ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400)):
        tail = _DIGITS.add(tail, _DIGITS.divide(Decimal(num), _DIGITS.multiply(Decimal(den), power)))
        power = _DIGITS.multiply(power, _DIGITS.multiply(x, x))
    main = _DIGITS.subtract(_DIGITS.multiply(_DIGITS.add(x, Decimal("0.5")), _DIGITS.ln(x)), x)
    return _DIGITS.add(_DIGITS.add(main, _HALF_LOG_2PI), tail)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    """A hypergeometric draw; from GENERATOR_LIMIT on, by Devroye's rejection for log-concave laws, which needs no table.

    Both follow the exact law; the probabilities of the second are computed to about 30 digits whatever the sizes.
    """
    if good + bad < GENERATOR_LIMIT:
        return int(rng.hypergeometric(good, bad, draw)) if draw else 0
    low, high = max(0, draw - bad), min(good, draw)
    if low == high:
        return low

    def log_weight(k: int) -> Decimal:
        total = Decimal(0)
        for n in (k, good - k, draw - k, bad - draw + k):
            total = _DIGITS.subtract(total, _log_factorial(n))
        return total

    mode = min(max((draw + 1) * (good + 1) // (good + bad + 2), low), high)
    top, n = log_weight(mode), good + bad
    rest = Decimal(0)
    for x, sign in ((good, 1), (bad, 1), (draw, 1), (n - draw, 1), (n, -1)):
        rest = _DIGITS.add(rest, _log_factorial(x) * sign)
    peak = math.exp(_DIGITS.add(top, rest))
    w = 1 + peak / 2
    while True:
        u, v = rng.random(2)
        y = (v * w if u <= w / (1 + w) else w + rng.exponential()) / peak
        k = mode + (round(y) if rng.random() < 0.5 else -round(y))
        bound = rng.random() * min(1.0, math.exp(w - peak * y))
        if low <= k <= high and bound <= math.exp(_DIGITS.subtract(log_weight(k), top)):
            return k


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Ranks of x under a keyed permutation of range(n): four Feistel rounds, repeated until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            mixed = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) & (2**64 - 1))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draw_plan(stats: list[tuple[str | None, int]], block: int, shards: int, seed: int, **law) -> dict:
    """For each source: size, target, blocks, passes, quota (blocks of the rest), cut (words of its last block), shard ends."""
    target = targets(stats, **law)
    plan = {}
    for key, (source, size) in enumerate(sorted(stats, key=lambda x: (x[0] is None, x[0] or ""))):
        want = round(target[source])
        passes, rest = divmod(want, size) if size else (0, 0)
        blocks = -(-size // block)
        last = size - (blocks - 1) * block if blocks else 0
        ranks = permuted(np.array([blocks - 1]), blocks, seed * 1009 + key)[0] if blocks else -1
        quota = -(-rest // block)  # blocks below this rank are drawn; if the short last block is among them, one more may be
        if blocks and ranks < quota and (quota - 1) * block + last < rest:
            quota += 1
        drawn = quota * block - (block - last if blocks and ranks < quota else 0)
        plan[source] = {"key": seed * 1009 + key, "size": size, "target": float(target[source]), "blocks": blocks, "passes": passes, "quota": quota, "cut": drawn - rest}
    order = list(plan)
    dealt = splitting_tree(np.array([plan[s]["passes"] * plan[s]["blocks"] + plan[s]["quota"] for s in order]), shards, seed)
    for i, s in enumerate(order):
        plan[s]["ends"] = np.cumsum(dealt[:, i])
    return plan


def segments(plan: dict, start: np.ndarray, size: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """What is drawn from one source's documents, which lie at words start … start + size of its stream.

    Arrays (document, pass, first word in the document, words, shard, sort key), in the order of documents, passes, words.
    """
    count = np.where(size > 0, (start + size - 1) // block - start // block + 1, 0)
    doc = np.repeat(np.arange(len(start)), count)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    blocks = start[doc] // block + inside
    ranks = permuted(blocks, max(1, plan["blocks"]), plan["key"])
    lo = np.maximum(blocks * block, start[doc])
    hi = np.minimum((blocks + 1) * block, (start + size)[doc])
    ends = np.minimum((blocks + 1) * block, plan["size"]) - np.where(ranks == plan["quota"] - 1, plan["cut"], 0)
    found = []
    for p in range(plan["passes"] + 1):
        last = hi if p < plan["passes"] else np.where(ranks < plan["quota"], np.minimum(hi, ends), lo)
        at = np.flatnonzero(last > lo)
        drawn = p * plan["blocks"] + ranks[at]
        shard = np.searchsorted(plan["ends"], drawn, side="right")
        found.append((doc[at], np.full(len(at), p), lo[at] - start[doc[at]], (last - lo)[at], shard, permuted(drawn, 1 << 62, plan["key"] + 1)))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block: int = 256, shards: int | None = None, seed: int = 20) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, text_hash, segments) for every row of docs (doc_id, text, source).

    size counts words (null text: 0); a null source is a source of its own, the last. segments lists what the mix takes
    of the document: (pass, start, length) in words, the output shard and the sort key in it; blocks that run on into the
    next document continue there under the same shard and key. Over a source, the lengths sum to its target, rounded.
    A document without words, and a source without, has no segments. Repeated rows and null ids are documents of their
    own. The result depends on the rows and the seed only. An empty table gives no rows; other columns are ignored.
    `shards` defaults to SHARDS, or as many as keep a shard at about SHARD_WORDS words.
    """
    rows = checkpointed(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    stats = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]  # one row a source
    shards = shards or max(SHARDS, -(-int(share * sum(n for _, n in stats)) // SHARD_WORDS))
    plan = draw_plan(stats, block, shards, seed, weights=weights, share=share, limit=limit) if stats else {}
    placed = running_start(rows, ["source"], ["doc_id", "text_hash", "size"], "size", "first")
    names = ("pass", "start", "length", "shard", "sort")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def run(batches):
        for batch in batches:
            source, groups = batch.column(1).to_pylist(), {}
            for i, s in enumerate(source):
                groups.setdefault(s, []).append(i)
            size, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            parts = []
            for s, members in groups.items():
                rows = np.array(members)
                doc, *rest = segments(plan[s], first[rows], size[rows], block)
                parts.append((rows[doc], *rest))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * 6
            order = np.argsort(columns[0], kind="stable")
            counts = np.bincount(columns[0].astype(np.int64), minlength=len(size))
            fields = [pa.array(c[order], k) for c, k in zip(columns[1:], kinds, strict=True)]
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.StructArray.from_arrays(fields, names=names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([plan[s]["size"] for s in source], pa.int64()), pa.array([plan[s]["target"] for s in source], pa.float64()), batch.column(3), found],
                names=["doc_id", "source", "size", "source_size", "target", "text_hash", "segments"],
            )

    return placed.select("doc_id", "source", "size", "text_hash", "first").mapInArrow(
        run, f"doc_id long, source string, size long, source_size long, target double, text_hash long, segments {SEGMENTS}"
    )


def _with_segments(docs: DataFrame, **law) -> DataFrame:
    """Rows (row: the whole row of docs, n: its words, segments) for the rows from which something is taken.

    Rows with equal doc_id, source and text have plans of their own and get one each: they are numbered on both sides.
    """
    keys = ["doc_id", "source", "text_hash"]
    plan = checkpointed(mix(docs, **law).where(F.size("segments") > 0).select(*keys, F.col("size").alias("n"), "segments"))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.xxhash64("text").alias("text_hash")).alias("_key"), F.struct("*").alias("row"))
    several = checkpointed(plan.groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1").select(F.struct(*keys).alias("_several")))
    plan = plan.select(F.struct(*keys).alias("_at"), "n", "segments")
    if several.isEmpty():
        return rows.join(plan, (F.col("_key") == F.col("_at"))).select("row", "n", "segments")

    def parted(df: DataFrame, key: str, how: str) -> DataFrame:
        return df.join(small(several), F.col(key) == F.col("_several"), how)

    def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
        some = parted(df, key, "left_semi").withColumn("_one", F.lit(1).cast("long")).withColumn("_order", F.monotonically_increasing_id())
        return running_start(checkpointed(some), [key], ["_order"], "_one", name)

    one = parted(rows, "_key", "left_anti").join(parted(plan, "_at", "left_anti"), (F.col("_key") == F.col("_at")))
    own, theirs = numbered(rows, "_key", "_i"), numbered(plan, "_at", "_j").drop("_one", "_order")
    more = own.join(theirs, (F.col("_key") == F.col("_at")) & (F.col("_i") == F.col("_j")))
    return one.select("row", "n", "segments").unionByName(more.select("row", "n", "segments"))


def _laid_out(df: DataFrame) -> DataFrame:
    """df (shard, sort, …) by shard, each shard in the order of sort, in RANGES files a shard at most."""
    return df.repartition("shard", F.shiftright("sort", 62 - (RANGES.bit_length() - 1))).sortWithinPartitions("shard", "sort")


def _words_of(text, segments):
    """The words of text that the segments name, joined by a space."""
    words = F.regexp_extract_all(text, F.lit(f"({_SIZE})"), F.lit(1))
    return F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(segments, lambda s: F.slice(w, (s["start"] + 1).cast("int"), s["length"].cast("int")))), " "))[0]


def mixed_blocks(docs: DataFrame, **law) -> DataFrame:
    """Rows (shard, sort, doc_id, pass, start, length, text): every drawn piece of a document, its words joined by a space.

    They are laid out by shard, each shard in the order of the keyed hash, its local shuffle; pieces of one block are
    neighbours. The shards' words differ by little more than a block. A row for each segment of `mix`.
    """
    found = _with_segments(docs, **law).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), F.explode("segments").alias("s"))
    return _laid_out(found.select("s.shard", "s.sort", "doc_id", "s.pass", "s.start", "s.length", _words_of(F.col("text"), F.array("s")).alias("text")))


def mixed_documents(docs: DataFrame, **law) -> DataFrame:
    """The documents of the mix, with all columns of docs: for each document and pass, a row with the words taken.

    A pass that takes a whole document keeps its text as it is; one that takes parts keeps their words, joined by a space.
    Documents from which nothing is taken are left out; repeated rows are documents of their own. So that documents stay
    whole, a row goes to the shard of its first drawn block, at that block's place in the shard's shuffled order: rows are
    laid out by shard and sort key. n_chars, where there is such a column, is counted again.
    """
    passes = F.array_distinct(F.transform("segments", lambda s: s["pass"]))
    rows = _with_segments(docs, **law).withColumn("p", F.explode(passes)).withColumn("own", F.filter("segments", lambda s: s["pass"] == F.col("p")))
    text = F.col("row")["text"]
    whole = F.aggregate("own", F.lit(0).cast("long"), lambda a, s: a + s["length"]) == F.col("n")
    row = F.col("row").withField("text", F.when(whole, text).otherwise(_words_of(text, F.col("own"))))
    rows = _laid_out(rows.select(F.col("own")[0]["shard"].alias("shard"), F.col("own")[0]["sort"].alias("sort"), row.alias("row")))
    if "n_chars" in docs.columns:
        rows = rows.select(F.col("row").withField("n_chars", F.length("row.text").cast("long")).alias("row"))
    return rows.select("row.*")
