"""SimHash near-duplicate detection with sharded BK-trees.

Fingerprints are distinct per shard before any tree is built, so copies cost nothing. Two fingerprints that differ in at
most `radius` bits agree on at least one of radius + 1 blocks of bits; a shard holds the fingerprints that agree on one
block. A shard with over SHARD_ROWS fingerprints is cut again by blocks of the bits that are still free, which is exact
for the same reason and, after LEVELS cuts, bounds every shard by its few free bits whatever the data. Each shard's
members build one BK-tree (children keyed by integer Hamming distance to the parent) in the task that holds them and
search it along edges within the radius. Only links that join two trees of the shard's union-find leave the task, so a
shard of n members gives at most n - 1 links.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, components, sliced, small

SHARD_ROWS = 4096
LEVELS = 4
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased word shingles, repeats included; 0 where there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64)
    lanes = h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    if len(h) < 200:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = (np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp long) for every row of docs; a null text counts as empty."""

    def run(batches):
        for batch in sliced(batches):
            found = [fingerprint(t, shingle_words, seed) for t in batch.column(1).to_pylist()]
            fps = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over integers of any width under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of all values at most `radius` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            edges = self.children[node]
            if len(edges) <= 2 * radius + 1:
                todo += [child for e, child in edges.items() if -radius <= e - d <= radius]
            else:
                todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while new:
            d = (self.values[node] ^ value).bit_count()
            if (child := self.children[node].get(d)) is None:
                self.children[node][d] = new
                break
            node = child
        return new


def shard_links(members: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links (id, id) that span the components of members (value, id) under the radius."""
    if len(members) == 2:
        (x, a), (y, b) = members
        return [(a, b)] if (x ^ y).bit_count() <= radius else []
    tree, parent, links = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value, _ in members:
        near = tree.within(value, radius)
        me = tree.add(value)
        parent.append(me)
        for other in near:
            a, b = root(other), root(me)
            if a != b:
                parent[b] = a
                links.append((members[other][1], members[me][1]))
    return links


def _split(free: int, parts: int) -> list[int]:
    """Masks that deal out the set bits of `free` into `parts` runs of nearly equal length."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[cuts[i] : cuts[i + 1]]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that span the components of distinct (fp long, rep long) rows under the radius.

    fp must be distinct. Every pair within the radius is joined by a path of links.
    """
    full = (1 << 64) - 1
    masks = _split(full, radius + 1)
    rows = distinct.select("fp", "rep", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    ready = None
    for level in range(1, LEVELS + 1):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        # Of its own, so that the join can be split where a shard is hot.
        counts = checkpointed(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
        held = checkpointed(rows.join(counts, ["mask", "key"]))
        keep = held if level == LEVELS else held.where(F.col("n") <= SHARD_ROWS)
        ready = keep if ready is None else ready.union(keep)
        if level == LEVELS or held.where(F.col("n") > SHARD_ROWS).isEmpty():
            break
        children = {m: [m | part for part in _split(full & ~m, radius + 1)] for m in masks}
        pairs = [x for m, subs in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))]
        rows = held.where(F.col("n") > SHARD_ROWS).select("fp", "rep", F.explode(F.create_map(*pairs)[F.col("mask")]).alias("mask"))
        masks = [s for subs in children.values() for s in subs]

    def run(batches):
        held, at = [], None
        for batch in batches:
            mask, key, fp, rep = (batch.column(i).to_pylist() for i in range(4))
            links = []
            for m, k, f, r in zip(mask, key, fp, rep, strict=True):
                if (m, k) != at:
                    links += shard_links(held, radius) if len(held) > 1 else []
                    held, at = [], (m, k)
                held.append((f & full, r))
            yield _pairs(links)
        yield _pairs(shard_links(held, radius) if len(held) > 1 else [])

    return (
        ready.select("mask", "key", "fp", "rep")
        .repartition("mask", "key")
        .sortWithinPartitions("mask", "key", "fp")
        .mapInArrow(run, "a long, b long")
    )


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, radius: int = 2, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp long, component_id) for every row of docs (doc_id, text; other columns are ignored).

    Rows with the same fingerprint, or fingerprints linked by steps of at most `radius` bits, share a component; its id is
    the smallest doc_id in it. Null, empty and wordless texts have fingerprint 0 and are linked like any other. Repeated
    rows stay repeated. A row with a null doc_id keeps its fingerprint, gets the component of its fingerprint's other rows
    and links nothing itself: where no other row has that fingerprint, its component is null. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, shingle_words, seed))
    distinct = checkpointed(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = checkpointed(near_links(distinct, radius))
    roots = components(links)
    labels = distinct.join(roots, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(labels, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


#: Bits of the wide fingerprint, whose distances choose the pairs whose shingles are compared.
WIDE_BITS = 1024
MINIMA = 6
#: More minima, by which shards of over WIDE_SHARD_ROWS members are cut: two documents at 0.8 share none in 3 of a million cases.
MORE = 8
WIDE_SHARD_ROWS = 1024
#: A shard of more blocks is cut; below, pairs of blocks copy each member less often than MORE minima and their blocks would.
CUT_BLOCKS = 16
#: A shard that is dealt out in blocks is first compared with so many of its members, in blocks of so many.
LEADERS = 64
LEADER_BLOCK = 512
#: Shingles of a block at most, 32 MB, so that a task holds few however long the texts are.
WIDE_SHARD_SHINGLES = 1 << 22
_SEEDS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1) for i in range(WIDE_BITS // 64 + MINIMA)], dtype=np.uint64)
_WIDE_LANES = (np.arange(WIDE_BITS // 8, dtype=np.int64) * 256)[None, :]


def _mixed(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    x = (h[:, None] ^ (h[:, None] >> np.uint64(32))) * seeds[None, :]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: bytes | None, shingle_words: int) -> np.ndarray:
    """The distinct 64-bit hashes, ascending, of the lower-cased word shingles; none without a word."""
    words = (text or b"").lower().split()
    n = max(1, len(words) - shingle_words + 1)
    if len(words) > shingle_words:
        shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle_words)), strict=True))
    else:
        shingles = [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), dtype=np.uint64))


def wide_sketch(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The wide SimHash of distinct shingle hashes, and MINIMA and MORE of their minima; zeros without a shingle."""
    if not len(h):
        return bytes(WIDE_BITS // 8), [0] * (MINIMA + MORE)
    ones = np.zeros((WIDE_BITS // 8, 8), dtype=np.int64)
    least = np.full(MINIMA + MORE, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(h), 4096):  # bounds memory on long texts
        mixed = _mixed(h[at : at + 4096], _SEEDS)
        lanes = np.ascontiguousarray(mixed[:, MINIMA:]).astype("<u8", copy=False).view(np.uint8)
        if len(lanes) < 400:
            ones += np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16).reshape(-1, 8)
        else:
            ones += np.bincount((lanes + _WIDE_LANES).ravel(), minlength=32 * WIDE_BITS).reshape(-1, 256) @ _BITS
        least = np.minimum(least, mixed[:, : MINIMA + MORE].min(axis=0))
    return np.packbits(ones.ravel() * 2 > len(h), bitorder="little").tobytes(), least.view(np.int64).tolist()


def radius_of(similarity: float, shingles: int) -> int:
    """Bits of WIDE_BITS beyond which no two texts of that Jaccard similarity differ, but for 1 pair in millions.

    `shingles` counts those of the smaller text. The share of bits that differ is arccos(2 s / (1 + s)) / pi for many
    shingles, at most 1.05 times that from 64 shingles on and 1.25 times below (enumerated); six deviations are added.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi) * (1.05 if shingles >= 64 else 1.25)
    return int(WIDE_BITS * p + 6 * (WIDE_BITS * p * (1 - p)) ** 0.5)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two arrays of distinct shingle hashes is at least that."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


class _Block:
    """Members of a task: wide fingerprints, shingle counts, minima, labels, and bits for the minima whose shards were cut."""

    def __init__(self, fps: list[bytes], sizes: list[int], mins: list[list[int]], labels: list[int], cut: list[int]) -> None:
        self.fps = np.frombuffer(b"".join(fps), dtype=np.uint64).reshape(-1, WIDE_BITS // 64)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.mins = np.array(mins, dtype=np.int64).reshape(-1, MINIMA + MORE)
        self.labels = np.array(labels, dtype=np.int64)
        self.whole = (np.array(cut, dtype=np.int64)[:, None] >> np.arange(MINIMA + MORE) & 1) == 0

    def found(self, one: bool, right: int, similarity: float):
        """(i, indices): the members from the second on, or those of the right block, and whom of the earlier or the left ones a BK-tree of the wide fingerprints finds within the radius of that similarity."""
        tree, radius = BKTree(), max(radius_of(similarity, 1), radius_of(similarity, 64))
        values = [int.from_bytes(row.tobytes(), "little") for row in self.fps]
        for value in values[: 1 if one else right]:
            tree.add(value)
        for i in range(1 if one else right, len(values)):
            yield i, np.sort(np.array(tree.within(values[i], radius), dtype=np.int64))
            if one:
                tree.add(values[i])

    def near(self, i: int, at: np.ndarray, last: int, sub: int, similarity: float) -> np.ndarray:
        """Which of the found ones, of another label, may be that similar to member i and weren't compared with it in an earlier shard.

        Two members met in the shard of an earlier minimum that they share, unless that shard was cut.
        """
        n = self.sizes[i]
        few, many = np.minimum(self.sizes[at], n), np.maximum(self.sizes[at], n)
        at = at[(few >= similarity * many) & (self.labels[at] != self.labels[i])]
        for before in (slice(0, last), slice(MINIMA, MINIMA + max(0, sub))):
            at = at[~((self.mins[at, before] == self.mins[i, before]) & self.whole[i, before]).any(axis=1)]
        if len(at):
            apart = np.bitwise_count(self.fps[at] ^ self.fps[i]).sum(axis=1, dtype=np.int64)
            at = at[apart <= np.where(np.minimum(self.sizes[at], n) >= 64, radius_of(similarity, 64), radius_of(similarity, 1))]
        return at


#: A shard's key: the members share the minimum number `last` and, where it was cut, the further one number `sub`, else -1.
_SHARD = ("last", "min", "sub", "submin")
#: Where the rows of a task go: blocks lo and hi of the shard; right: the row is of block hi.
_TASK = (*_SHARD, "lo", "hi", "right")
_KEY_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int64())


def _tasks(batches, names: list[str]):
    """(shard, is one block, start of the right block, columns) of each run of rows of one task."""
    at, held = None, []

    def task():
        right = [r[0] for r in held]
        return at[:4], at[4] == at[5], right.index(True) if True in right else len(held), list(zip(*(r[1:] for r in held), strict=True))

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*_TASK, *names)]
        for row in zip(*columns, strict=True):
            if row[:6] != at:
                if len(held) > 1:
                    yield task()
                at, held = row[:6], []
            held.append(row[6:])
    if len(held) > 1:
        yield task()


def _blocks(rows, held):
    return F.greatest(F.ceil(rows / WIDE_SHARD_ROWS), F.ceil(held / WIDE_SHARD_SHINGLES)).cast("int")


def _sharded(members: DataFrame) -> DataFrame:
    """Members (sig, rep, size, label, *_SHARD) of the shards that hold two labels or more, with their shard's number of blocks.

    The counts are a table of their own, so that the join with them can be split where a shard is hot.
    """
    found = members.groupBy(*_SHARD).agg(F.count("*").alias("n"), F.sum("size").alias("held"), F.min("label").alias("a"), F.max("label").alias("b"))
    counts = checkpointed(found.where("a < b").select(*_SHARD, _blocks(F.col("n"), F.col("held")).alias("blocks")))
    return checkpointed(members.join(counts, list(_SHARD)))


def _star_tasks(hot: DataFrame) -> DataFrame:
    """(sig, *_TASK): the members of hot shards in blocks of LEADER_BLOCK, each block with the shard's LEADERS on the left."""
    inside = hot.select("sig", *_SHARD, F.ceil(F.col("blocks") * (WIDE_SHARD_ROWS / LEADER_BLOCK)).cast("int").alias("parts"))
    first = Window.partitionBy(*_SHARD).orderBy(F.xxhash64("sig", F.lit(17)), "sig")
    leaders = inside.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= LEADERS)
    parts = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i.cast("string"))
    left = leaders.select("sig", *_SHARD, F.explode(parts).alias("lo"), F.lit(False).alias("right"))
    own = F.pmod(F.xxhash64("sig", F.lit(13)), "parts").cast("string")
    both = left.union(inside.select("sig", *_SHARD, own.alias("lo"), F.lit(True).alias("right")))
    return both.withColumn("hi", F.lit("leaders")).select("sig", *_TASK)


def _pair_tasks(held: DataFrame) -> DataFrame:
    """(sig, *_TASK): every two of the members (sig, size, label, *_SHARD, blocks) of a shard with different labels meet in a task.

    A shard of one block is one task. In the others, labels with over WIDE_SHARD_ROWS members have blocks of their own and
    the rest share blocks; two blocks have a task unless both are of one label. So a large group that is joined already
    costs its size times the number of other members' blocks, not its square.
    """
    shard = list(_SHARD)
    whole = held.where("blocks = 1").select("sig", *shard, F.lit("").alias("lo"), F.lit("").alias("hi"), F.lit(False).alias("right"))
    hot = held.where("blocks > 1").select("sig", "size", "label", *shard)
    if hot.isEmpty():
        return whole
    sizes = checkpointed(hot.groupBy(*shard, "label").agg(F.count("*").alias("n"), F.sum("size").alias("held")))
    number = _blocks(F.col("n"), F.col("held")).alias("k")
    large = checkpointed(sizes.where(F.col("n") > WIDE_SHARD_ROWS).select(*shard, "label", F.col("label").cast("string").alias("part"), number))
    rest = sizes.where(F.col("n") <= WIDE_SHARD_ROWS).groupBy(*shard).agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    rest = checkpointed(rest.select(*shard, F.lit("rest").alias("part"), number))
    # Numbered before the union: Spark 4.1 fails on some unions whose child is a bare checkpoint (it keeps constraints on columns that are gone).
    numbered = [df.select(*shard, "part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")) for df in (large, rest)]
    blocks = checkpointed(numbered[0].union(numbered[1]).withColumn("id", F.concat_ws(":", "part", "i")))
    a, b = (blocks.select(*shard, *[F.col(c).alias(f"{c}{x}") for c in ("part", "i", "id")]) for x in "ab")
    apart = (F.col("parta") < F.col("partb")) | ((F.col("parta") == "rest") & (F.col("partb") == "rest") & (F.col("ia") <= F.col("ib")))
    pairs = checkpointed(a.join(b, shard).where(apart).select(*shard, F.col("ida").alias("lo"), F.col("idb").alias("hi")))

    def placed(df: DataFrame):
        own = F.pmod(F.xxhash64("sig", F.lit(13)), "k")
        return df.select("sig", *shard, F.concat_ws(":", "part", own.cast("string")).alias("id"))

    own = placed(hot.join(large, [*shard, "label"])).union(placed(hot.join(large, [*shard, "label"], "left_anti").join(rest, shard)))
    own = checkpointed(own)
    left = own.join(pairs.withColumn("id", F.col("lo")), [*shard, "id"]).withColumn("right", F.lit(False))
    right = own.join(pairs.where("lo != hi").withColumn("id", F.col("hi")), [*shard, "id"]).withColumn("right", F.lit(True))
    return whole.union(left.union(right).select("sig", *_TASK))


def _by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_TASK[:-1]).sortWithinPartitions(*_TASK, "sig")


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """Rows (doc_id, component_id) for every row of docs (doc_id, text): groups of texts linked at that similarity or more.

    Similarity is the Jaccard similarity of the sets of word shingles, each told by a 64-bit hash, and a link is made only
    where it was computed from the two sets. The pairs to compare are those that share one of MINIMA minimum hashes (two
    documents at 0.8 share none of six in 6 of 100,000 cases) and whose wide SimHash fingerprints lie within radius_of, as
    a BK-tree of the shard's fingerprints finds them; each is compared in the shard of its first shared minimum that isn't cut, and in the cut ones before it.
    A shard with over WIDE_SHARD_ROWS members is first compared with LEADERS of them; members that this joins to one
    group are not compared with each other any more. Where others are left, they are compared in pairs of blocks that have
    a task each; a shard of over CUT_BLOCKS blocks is cut by MORE further minima before, so that texts which only share a
    frequent passage part ways: there, and only for pairs without an uncut shard in common, one of these must be shared as
    well. Only members with a pair to compare have their shingles sent. Texts with the same shingles, as those
    without a word, share a group. Null ids, repeated rows and empty tables: as in near_duplicates.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))

    def hashed(batches):
        for batch in sliced(batches):
            found = [shingle_hashes(t, shingle_words) for t in batch.column(1).to_pylist()]
            sigs = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())
            yield batch.column(0), sigs, found

    def sketch(batches):
        for ids, sigs, found in hashed(batches):
            fps, mins = zip(*map(wide_sketch, found), strict=True) if found else ((), ())
            columns = [ids, sigs, pa.array([len(h) for h in found], pa.int64()), pa.array(fps, pa.binary()), pa.array(mins, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sig", "size", "fp", "mins"])

    def shingles(batches):
        for ids, sigs, found in hashed(batches):
            yield pa.RecordBatch.from_arrays([ids, sigs, pa.array([h.tobytes() for h in found], pa.binary())], names=["doc_id", "sig", "shingles"])

    sketched = checkpointed(texts.mapInArrow(sketch, "doc_id long, sig binary, size long, fp binary, mins array<long>"))
    least = [F.min(c).alias(c) for c in ("size", "fp", "mins")]
    distinct = checkpointed(sketched.where("doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), *least))

    def marks(batches):
        columns = tuple([] for _ in range(5))

        def batch():
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), *_KEY_TYPES), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["sig", *_SHARD])

        for shard, one, right, (sig, size, fp, mins, label, cut) in _tasks(batches, ["sig", "size", "fp", "mins", "label", "cut"]):
            block, found = _Block(fp, size, mins, label, cut), np.zeros(len(sig), dtype=bool)
            for i, at in block.found(one, right, similarity):
                near = block.near(i, at, shard[0], shard[2], similarity)
                found[near] = True
                found[i] |= len(near) > 0
            for i in np.flatnonzero(found).tolist():
                for column, value in zip(columns, (sig[i], *shard), strict=True):
                    column.append(value)
            if len(columns[0]) >= 4096:
                yield batch()
                columns = tuple([] for _ in range(5))
        yield batch()

    def compared(batches):
        links = []
        for shard, one, right, (rep, size, fp, mins, label, cut, held) in _tasks(batches, ["rep", "size", "fp", "mins", "label", "cut", "shingles"]):
            block, parent = _Block(fp, size, mins, label, cut), list(range(len(rep)))
            sets = [np.frombuffer(h, dtype=np.uint64) for h in held]

            def root(i: int, parent=parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, at in block.found(one, right, similarity):
                for j in block.near(i, at, shard[0], shard[2], similarity).tolist():
                    a, b = root(j), root(i)
                    if a != b and alike(sets[j], sets[i], similarity):
                        parent[b] = a
                        links.append((rep[j], rep[i]))
            if len(links) >= 4096:
                yield _pairs(links)
                links = []
        yield _pairs(links)

    def linked(tasks: DataFrame, known: DataFrame) -> DataFrame:
        """Links (a, b) between the members of each task that are similar; known: distinct with labels."""
        tasks = checkpointed(tasks)
        sketches = known.select("sig", "rep", "size", "fp", "mins", "label", "cut")
        marked = checkpointed(_by_task(tasks.join(sketches, "sig")).mapInArrow(marks, "sig binary, last int, min long, sub int, submin long").distinct())
        sent = checkpointed(marked.select("sig").distinct().join(known.select("sig", "rep"), "sig"))
        have = texts.join(small(sent.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
        sets = have.mapInArrow(shingles, "doc_id long, sig binary, shingles binary").join(sent.withColumnRenamed("rep", "doc_id"), ["doc_id", "sig"], "left_semi")
        sets = sets.dropDuplicates(["sig"]).select("sig", "shingles")
        ready = tasks.join(marked, ["sig", *_SHARD], "left_semi").join(sketches, "sig").join(sets, "sig")
        return checkpointed(_by_task(ready).mapInArrow(compared, "a long, b long"))

    known, links = distinct.withColumn("label", F.col("rep")).withColumn("cut", F.lit(0).cast("long")), None
    key = "sig", "rep", "size", "label"
    whole = F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("submin")
    held = _sharded(known.select(*key, F.posexplode(F.slice("mins", 1, MINIMA)).alias("last", "min")).select(*key, "last", "min", *whole))
    hot = held.where("blocks > 1")
    if not hot.isEmpty():
        links = linked(_star_tasks(hot), known)
        labels = checkpointed(components(links).select(F.col("node").alias("rep"), F.col("component").alias("new")))

        def renamed(df: DataFrame) -> DataFrame:
            return df.join(small(labels), "rep", "left").withColumn("label", F.coalesce("new", "label")).drop("new")

        known, held = renamed(known), renamed(held)
        ends = held.groupBy(*_SHARD).agg(F.min("label").alias("a"), F.max("label").alias("b"))
        held = checkpointed(held.join(checkpointed(ends.where("a < b").select(*_SHARD)), list(_SHARD)))
        large = held.where(F.col("blocks") > CUT_BLOCKS)
        if not large.isEmpty():
            parted = checkpointed(large.groupBy("sig").agg(F.sum(F.pow(F.lit(2), F.col("last")).cast("long")).alias("cut")))
            known = known.drop("cut").join(parted, "sig", "left").withColumn("cut", F.coalesce("cut", F.lit(0).cast("long")))
            cut = large.join(distinct.select("sig", F.slice("mins", MINIMA + 1, MORE).alias("more")), "sig")
            cut = cut.select(*key, "last", "min", F.posexplode("more").alias("sub", "submin"))
            held = checkpointed(held.where(F.col("blocks") <= CUT_BLOCKS).unionByName(_sharded(cut)))
    more = linked(_pair_tasks(held), known)
    roots = components(more if links is None else links.union(more))
    found = distinct.join(roots, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep"))
    labels = found.select(F.col("sig").alias("_sig"), F.col("label").alias("component_id"))
    return sketched.select("doc_id", "sig").join(labels, F.col("sig") == F.col("_sig"), "left").select("doc_id", "component_id")
