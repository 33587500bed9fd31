"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from quillon.llm import negatives as N
from quillon.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v int"


def brute(rows, every=50, positives=5, negatives=3):
    held = set()
    for vec_id, v, label in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    usual = max({len(v) for _, _, v in held}, key=lambda d: (sum(len(v) == d for _, _, v in held), -d), default=0)
    held = [r for r in held if len(r[2]) == usual]
    found = set()
    for anchor in {i for i, _, _ in held if i % every == 0}:
        _, label, a = min((r for r in held if r[0] == anchor), key=lambda r: (r[1], r[2]))
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i, lab) for i, lab, v in held if i != anchor)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            own = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            found |= {(anchor, i, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(own)}
    return sorted(found)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA)
    return sorted(set(map(tuple, N.hard_negatives(df, **more).collect())))


def table(n, d=6, seed=1, copies=0, step=1):
    rng = np.random.default_rng(seed)
    rows = [(step * i, rng.standard_normal(d).round(2).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    return rows + [(step * (n + i), rows[3][1], i % 3) for i in range(copies)]


@pytest.mark.parametrize(("block", "first"), [(4096, 8), (8, 1)])
def test_against_all_pairs(spark, monkeypatch, block, first):
    """Small blocks and one visit a round; a third of the rows is one vector, so ties reach over blocks."""
    monkeypatch.setattr(N, "FIRST_VISITS", first)
    monkeypatch.setattr(N.inverted_lists, "__defaults__", (block,))
    rows = table(240, copies=120)
    got = mined(spark, rows, every=25)
    assert got == brute(rows, every=25) and len(got) > 50


def test_odd_rows(spark):
    rows = table(80, d=4, seed=5)
    rows += [(None, [1.0] * 4, 1), (300, None, 1), (350, [1.0, None, 1.0, 1.0], 1), (400, [1.0, math.nan, 1.0, 1.0], 2), (450, [math.inf, 0.0, 0.0, 0.0], 2), (500, [1.0] * 4, None)]
    rows += [(550, [1.0, 2.0], 1), (600, [], 1), (650, [0.0] * 4, 1), (700, [1e-20, -1e-20, 1.0, 1.0], 1), (50, rows[50][1], rows[50][2]), (50, [0.5] * 4, 2), (7, [3.0] * 4, 9)]
    assert mined(spark, rows) == brute(rows)
    assert any(r[0] == 700 for r in mined(spark, rows))


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 1.0], 1)]) == []
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 2), (2, [0.7, 0.8], 3), (3, [1.0, 1.0], 2)]
    assert mined(spark, rows) == brute(rows) != []


def test_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 1e5 for _ in range(3)], i % 3) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_products_beyond_doubles():
    a = np.array([[2.0**40, 3.0]])
    b = np.array([[2.0**20, 1.0], [2.0**40, 2.0**45]])
    assert N.products(a, b)[0].tolist() == [2**60 + 3, N._MOST]


def test_bounds_hold_and_visits_stop():
    rng = np.random.default_rng(4)
    x = rng.integers(-200, 200, (2000, 5)).astype(float)
    x[:500] = x[:500] / 20 + 300  # a cluster of its own
    centres = N.kmeans(x, 30)
    own = N.nearest(x, centres)
    radii = np.array([np.sqrt(np.square(x[own == c] - centres[c]).sum(axis=1)).max(initial=0.0) for c in range(len(centres))])
    directory = N.Directory(centres, radii)
    low, high = directory.bounds(x[:50])
    scores = x[:50] @ x.T
    assert (scores <= high[:, own]).all() and (scores >= low[:, own]).all()
    none = np.full((50, 1), float(N._LEAST))
    kth = np.sort(scores, axis=1)[:, -5:-4]
    every, _ = directory.visits(x[:50], 0, 30, none, -none, none)
    some, _ = directory.visits(x[:50], 0, 30, none, -none, kth)
    assert every.all() and some.sum() < 0.5 * every.sum()
    for i in range(50):  # every row above or at the k-th score lies in a visited cluster
        assert some[i, own[scores[i] >= kth[i]]].all()
    met, more = directory.visits(x[:50], 0, 3, none, -none, none)
    assert (met.sum(axis=1) == 3).all() and more.all()


def test_query(spark):
    import pyarrow.parquet as pq

    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()]
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, "/root/testdata/sf0.001").collect())) == brute(rows)
