"""Groups of similar documents against all pairs."""

import random

import pytest

from quillon.llm import simhash as S

SCHEMA = "doc_id long, text string"


def shingle_set(text, width=5):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def brute(texts, similarity=0.8):
    """Smallest member of each text's component under the exact Jaccard similarity."""
    sets, holds, parent = [shingle_set(t) for t in texts], {}, list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for b, x in enumerate(sets):
        for a in {a for s in x for a in holds.get(s, ())}:
            if len(sets[a] & x) >= similarity * len(sets[a] | x):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
        for s in x:
            holds.setdefault(s, []).append(b)
    return {i: root(i) for i in range(len(texts))}


def groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: r["component_id"] for r in S.similar_documents(docs).collect()}


@pytest.mark.parametrize("cap", [1024, 1])
def test_one_shared_minimum_suffices_in_hot_shards(spark, monkeypatch, cap):
    monkeypatch.setattr(S, "WIDE_SHARD_ROWS", cap)
    rng, texts = random.Random(7), []
    for k in range(600):  # pairs at 0.84, each the only one of its kind
        w = [f"w{k}x{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(w), " ".join(w[:183] + [f"v{k}x{rng.randrange(10**6)}" for _ in range(17)])]
    least = [S.wide_sketch(S.shingle_hashes(t.encode(), 5))[1][: S.MINIMA] for t in texts]
    shared = [sum(x == y for x, y in zip(a, b, strict=True)) for a, b in zip(least[::2], least[1::2], strict=True)]
    assert min(shared) in (1, 2)
    assert groups(spark, texts) == brute(texts)


@pytest.mark.parametrize("cap", [1024, 3])
def test_links_are_verified_at_the_similarity(spark, monkeypatch, cap):
    monkeypatch.setattr(S, "WIDE_SHARD_ROWS", cap)
    rng, texts = random.Random(11), []
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for n in (5, 6, 8, 10, 12, 13, 20, 40, 100, 304):  # from one shingle on, either side of 0.8
        for _ in range(12):
            w = new(n)
            texts.append(" ".join(w))
            for cut in range(-3, 4):  # words changed at the end, about as many as 0.8 allows
                k = max(0, round((n - 4) / 9) + cut)
                texts += [" ".join(w[: n - k] + new(k)), " ".join(w + new(max(0, round((n - 4) / 4) + cut)))]
    w = new(200)  # a family that one passage of its own joins, in one hot shard
    texts += [" ".join(w + new(40 + i % 30)) for i in range(60)]
    v = new(30)  # the same shingles, as often as you like
    texts += [" ".join(v), " ".join(v * 2), " ".join(v * 40)]
    got, want = groups(spark, texts), brute(texts)
    assert {i for i in want if got[i] != want[i]} == set()


@pytest.mark.parametrize("shingles", [4, 8, 20, 100])
def test_exactly_the_similarity_counts(spark, shingles):
    """One in five of the union's shingles in one text only is 0.8; one more is less."""
    rng = random.Random(shingles)
    w = [f"w{rng.randrange(10**9)}" for _ in range(2 * shingles + 9)]
    n, more = shingles + 4, shingles // 4
    at, below = (" ".join(w[: n + more + k]) for k in (0, 1))
    base = " ".join(w[:n])
    assert groups(spark, [base, at]) == {0: 0, 1: 0}
    assert groups(spark, [base, below]) == {0: 0, 1: 1}


@pytest.mark.parametrize("blocks", [16, 1])
def test_hot_groups_of_several_kinds(spark, monkeypatch, blocks):
    """Large groups that leaders join, strays that share their minima only, and chains that leaders miss."""
    monkeypatch.setattr(S, "CUT_BLOCKS", blocks)
    monkeypatch.setattr(S, "WIDE_SHARD_ROWS", 20)
    monkeypatch.setattr(S, "LEADERS", 2)
    monkeypatch.setattr(S, "LEADER_BLOCK", 8)
    rng, texts = random.Random(13), []
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for _ in range(3):
        base = new(150)
        for i in range(60):  # all similar to each other
            w = list(base)
            w[i % 150] = f"x{i}"
            texts.append(" ".join(w))
        texts += [" ".join(base[:110] + new(60 + i)) for i in range(30)]  # share minima, not similar
        w = list(base)
        for _ in range(25):  # each similar to the one before, the last not to the first
            w = w[8:] + new(8)
            texts.append(" ".join(w))
    got, want = groups(spark, texts), brute(texts)
    assert {i for i in want if got[i] != want[i]} == set()


def test_joined_members_are_not_paired_again(spark, monkeypatch):
    monkeypatch.setattr(S, "WIDE_SHARD_ROWS", 20)
    rows = [(f"{i}".encode(), i, 10, 1 if i < 500 else i, 0, 7, -1, 0) for i in range(530)]
    members = spark.createDataFrame(rows, "sig binary, rep long, size long, label long, last int, min long, sub int, submin long")
    tasks = S._pair_tasks(S._sharded(members)).collect()
    assert len(tasks) < 4 * 530  # 25 blocks of the group meet two of the others, not each other
    by_task = {}
    for r in tasks:
        by_task.setdefault((r["lo"], r["hi"]), {False: set(), True: set()})[r["right"]].add(int(r["sig"]))
    met = {(min(a, b), max(a, b)) for (lo, hi), t in by_task.items() for a in t[False] for b in (t[False] if lo == hi else t[True]) if a != b}
    assert {(a, b) for a in range(530) for b in range(max(a + 1, 500), 530)} <= met


def test_a_cut_shard_hides_no_link_of_a_cold_one(spark, monkeypatch):
    """Pairs that share a minimum in a cut shard, another in a shard of two, and not the further minimum that the cut goes by."""
    monkeypatch.setattr(S, "CUT_BLOCKS", 1)
    monkeypatch.setattr(S, "WIDE_SHARD_ROWS", 10)
    monkeypatch.setattr(S, "MORE", 1)
    rng, texts, kept = random.Random(29), [], 0
    passage = [f"p{rng.randrange(10**9)}" for _ in range(60)]
    while kept < 40:
        w = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        a, b = " ".join(passage + w), " ".join(passage + w[:275] + [f"v{rng.randrange(10**9)}" for _ in range(25)])
        x, y = (S.wide_sketch(S.shingle_hashes(t.encode(), 5))[1] for t in (a, b))
        own = S.wide_sketch(S.shingle_hashes(" ".join(passage).encode(), 5))[1]
        shared = [m for m in range(S.MINIMA) if x[m] == y[m]]
        common = [m for m in shared if x[m] == own[m]]
        if common and any(m > common[0] and m not in common for m in shared) and x[S.MINIMA] != y[S.MINIMA]:
            texts, kept = texts + [a, b], kept + 1
    assert groups(spark, texts) == brute(texts)
