"""Targets written out by hand, the tree's part in the result, repeated rows, layout."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import words

from quillon.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, shard int"


def table(spark, sizes):
    """sizes: (source, words) of each document."""
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(n)), s, 7) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_by_hand():
    # 1000 words each, 1.5 x 4000 = 6000 to share at 3:1:2:3; a and d would get 2000 each and stop just there.
    assert mixing.targets([("a", 1000), ("b", 1000), ("c", 1000), ("d", 1000)]) == pytest.approx({"a": 2000, "b": 2000 / 3, "c": 4000 / 3, "d": 2000})
    # 165 to share at 3:1:2. a stops at 20; of the other 145, c gets two thirds, 96.67, but stops at 20; b takes 125.
    assert mixing.targets([("a", 10), ("b", 90), ("c", 10)]) == pytest.approx({"a": 20, "b": 125, "c": 20})
    # Null comes last, so its weight is 2: of 150, b has 1/6 and null 2/6 of what a's 3/6 leaves open.
    assert mixing.targets([(None, 50), ("b", 40), ("a", 10)]) == pytest.approx({"a": 20, "b": 130 / 3, None: 260 / 3})
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


def test_words_taken_meet_the_targets(spark):
    docs = table(spark, [("a", 10), *[("b", 9)] * 10, ("c", 10)])
    taken = Counter()
    for r in mixing.mixed_documents(docs, block=4).collect():
        taken[r["source"]] += len(words(r["text"]))
    assert taken == {"a": 20, "b": 125, "c": 20}


def test_the_tree_deals_the_blocks(spark, monkeypatch):
    docs = table(spark, [("abc"[i % 3], 20 + i) for i in range(90)])
    loads, of_source, all_ranks = Counter(), defaultdict(Counter), []
    for r in mixing.mix(docs, block=8, shards=4).collect():
        for s in r["segments"]:
            loads[s["shard"]] += s["length"]
            of_source[s["shard"]][r["source"]] += s["length"]
            all_ranks.append(s["sort"])
    assert set(loads) == set(range(4)) and max(loads.values()) - min(loads.values()) < 0.03 * sum(loads.values())
    assert all(len(c) == 3 for c in of_source.values()) and len(set(all_ranks)) > 0.5 * len(all_ranks)
    before = sorted(mixing.mixed_blocks(docs, block=8, shards=4).collect())
    monkeypatch.setattr(mixing, "splitting_tree", lambda counts, shards, seed: np.array([counts, *[counts * 0] * (shards - 1)]))
    after = sorted(mixing.mixed_blocks(docs, block=8, shards=4).collect())
    assert before != after and {r["shard"] for r in after} == {0}


def test_the_query_shows_the_draws(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    name = "op7_source_mix"
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, sf).collect()}
    for r in got.values():
        drawn = [tuple(map(int, x.split(":"))) for x in r["drawn"].split(",") if x]
        assert sum(x[2] for x in drawn) == r["taken"] and all(0 <= x[3] < mixing.SHARDS for x in drawn)
    monkeypatch.setattr(mixing, "splitting_tree", lambda counts, shards, seed: np.array([counts, *[counts * 0] * (shards - 1)]))
    assert {r["doc_id"]: r for r in queries.queries()[name](spark, sf).collect()} != got


def test_blocks_are_laid_out_and_hold_the_mix(spark):
    docs = table(spark, [("ab"[i % 2], 5 * i) for i in range(60)])
    parts = mixing.mixed_blocks(docs, block=16, shards=5).rdd.glom().collect()
    seen = Counter()
    for part in parts:
        assert [(r["shard"], r["sort"]) for r in part] == sorted((r["shard"], r["sort"]) for r in part)
        for r in part:
            assert words(r["text"]) == [f"d{r['doc_id']}w{j}" for j in range(r["start"], r["start"] + r["length"])]
            seen[r["doc_id"], r["pass"], r["start"], r["length"]] += 1
    plan = Counter((r["doc_id"], s["pass"], s["start"], s["length"]) for r in mixing.mix(docs, block=16, shards=5).collect() for s in r["segments"])
    assert seen == plan


def test_documents_are_laid_out_by_their_first_block(spark):
    docs = table(spark, [("ab"[i % 2], 5 * i) for i in range(60)])
    first = {}
    for r in mixing.mix(docs, block=16, shards=5).collect():
        for s in r["segments"]:
            first.setdefault((r["doc_id"], s["pass"]), (s["shard"], s["sort"]))
    places = defaultdict(set)
    for i, p in first:
        places[i].add(first[i, p])
    for part in mixing.mixed_documents(docs, block=16, shards=5).rdd.glom().collect():
        at = (-1, -1)
        for r in part:  # of a document's places, one must not lie before the row above
            at = min(x for x in places[r["doc_id"]] if x >= at)


def test_repeated_rows_are_documents_of_their_own(spark):
    text = " ".join(f"w{j}" for j in range(3000))
    rows = [(1, text, "b", 7)] * 3 + [(2, "other words here", "a", 7), (None, text, "b", 7), (None, text, "b", 7), (1, text, None, 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan, taken, held = Counter(), Counter(), mixing.mix(docs).collect()
    targets = {r["source"]: r["target"] for r in held}
    for r in held:
        plan[r["source"]] += sum(s["length"] for s in r["segments"])
    for r in mixing.mixed_documents(docs).collect():
        taken[r["source"]] += len(words(r["text"]))
    assert taken == +plan and all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    blocks = Counter()
    for r in mixing.mixed_blocks(docs).collect():
        blocks[r["doc_id"]] += len(words(r["text"]))
    assert sum(blocks.values()) == sum(plan.values())
