"""Connected components against union-find, by either path."""

import random

import pytest

from quillon.llm import common


def brute(links):
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return {i: root(i) for i in list(parent)}


@pytest.mark.parametrize("few", [common.FEW_EDGES, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rng = random.Random(1)
    links = [(rng.randrange(2000), rng.randrange(2000)) for _ in range(900)]
    links += [(5000, 5000 + i) for i in range(1, 3000)]  # a hub
    links += [(9000 + i, 9001 + i) for i in range(40)] + [(-7, -7), (-9, -8)]  # a chain, a loop
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in brute(links).items() if i != c}


def test_no_links(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
