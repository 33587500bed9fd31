"""Multi-index hashing: the pigeonhole against all codes, recall over several shards, odd rows."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillon.llm import ann

SCHEMA = "vec_id long, embedding array<double>, query_id long, score string, rank int, shard string, v int, asks int"


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 1, "s", 2, "t", 3, 4) for i, v in zip(ids, x, strict=True)], SCHEMA)


def nearest(ids, x, q, k):
    far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    return [(int(ids[i]), float(far[i])) for i in np.lexsort((ids, far)) if ids[i] != q][:k]


@pytest.mark.parametrize("parts", [1, 3, 4])
def test_probing_finds_every_code_within_the_radius(parts):
    rng = np.random.default_rng(parts)
    x = rng.standard_normal((400, 24))
    x[50:80] = x[:30]  # equal codes
    coder = ann.Coder(x, parts)
    index = ann.ShardIndex(np.arange(400), x, coder)
    codes = coder(x)
    for radius in (0, 1, 40, 100 * parts, 256 * parts):
        assert sum(t + 1 for t in ann.thresholds(radius, parts)) == radius + 1
        for q in range(0, 100, 7):
            want = [i for i in range(400) if int(np.bitwise_count(codes[i] ^ codes[q]).sum()) <= radius]
            assert index.within(codes[q], radius).tolist() == want


def test_probing_prunes():
    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist())
    coder = ann.Coder(x)
    index, radius = ann.ShardIndex(np.arange(len(x)), x, coder), ann.calibrated_radius(ann.Coder(x), x, 10)
    probed = np.mean([len(index.probed(c, radius)) for c in coder(x[:100])])
    assert probed < 0.06 * len(x)


def test_recall_on_a_hundred_queries_and_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"], dtype=float)
    got = {}
    for r in ann.nearest_neighbours(table(spark, ids, x), every=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = ids[ids % 20 == 0]
    assert set(got) == set(queries.tolist()) and len(queries) >= 100
    hits = 0
    for q, found in got.items():
        found.sort()
        best = nearest(ids, x, q, 10)
        assert [r for r, _, _ in found] == list(range(1, 11)) and [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        far = {i: float(np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum())) for _, i, _ in found}
        assert all(s == pytest.approx(far[v], abs=1e-12) for _, v, s in found)
        hits += len({v for v, _ in best} & {v for _, v, _ in found})
    assert hits >= 0.9 * 10 * len(got)


def test_repeated_ids_and_few_candidates(spark):
    x = np.array([[1.0, 0], [1, 0.1], [1, 0.2], [0, 1], [0.5, 0.5], [0, 3]])
    ids = np.array([0, 0, 7, 7, 7, 200])  # two rows ask as 0: the smaller vector does
    got = ann.nearest_neighbours(table(spark, ids, x)).collect()
    asked = {q: sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q) for q in (0, 200)}
    assert asked[0] == [(1, 7), (2, 7), (3, 7), (4, 200)] and [i for _, i in asked[200]] == [7, 7, 7, 0, 0]
    best = sorted(r["score"] for r in got if r["query_id"] == 0)
    assert best == pytest.approx(sorted(np.sqrt(((x[2:] - x[0]) ** 2).sum(axis=1))))


def test_many_equal_vectors(spark):
    x = np.ones((3000, 4)) * [1, 2, 3, 4]
    got = ann.nearest_neighbours(table(spark, np.arange(3000), x)).collect()
    for q in range(0, 3000, 100):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i in range(11) if i != q][:10]
        assert all(r["score"] == 0 for r in got)
