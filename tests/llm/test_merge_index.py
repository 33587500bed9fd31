"""The log-structured merge index: runs, their filters, compaction."""

import random

import pytest

from quillon.llm import exact


def entries(spark, n=3000, parts=6):
    rng = random.Random(4)
    rows = [(rng.randrange(1500).to_bytes(4) * 8, rng.randrange(5), None if rng.random() < 0.1 else rng.randrange(100), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key binary, chars long, doc_id long, row long").repartition(parts).cache()


def best(rows):
    found = {}
    for key, chars, doc_id, row in rows:
        found.setdefault(key, []).append((-chars, doc_id is None, doc_id or 0, row))
    return {k: (min(v)[3], len(v)) for k, v in found.items()}


def test_filters_hold_their_keys():
    keys = [random.Random(i).randbytes(32) for i in range(5000)]
    bits = exact.run_filter(keys[:4000])
    held = exact.maybe_held(bits, exact._places(keys))
    assert held[:4000].all() and held[4000:].mean() < 0.02


def test_runs_are_sorted_and_headed_by_their_filter(spark):
    _, df = entries(spark)
    for part in exact.flush(df, 200).rdd.glom().collect():
        runs = {}
        for r in part:
            runs.setdefault(r["run"], []).append(r)
        for rows in runs.values():
            head, keys = rows[0], [bytes(r["key"]) for r in rows[1:]]
            assert head["key"] is None and head["n"] == len(keys) <= 200 and keys == sorted(set(keys))
            assert exact.maybe_held(bytes(head["filter"]), exact._places(keys)).all()
        assert len(runs) > 1


@pytest.mark.parametrize("limit", [exact.FILTERS_BYTES, 0])
@pytest.mark.parametrize("memtable", [50, 100_000])
def test_compaction_keeps_the_best(spark, monkeypatch, limit, memtable):
    monkeypatch.setattr(exact, "FILTERS_BYTES", limit)
    rows, df = entries(spark)
    got = exact.compact(exact.flush(df, memtable).cache()).collect()
    assert {bytes(r["key"]): (r["keep_row"], r["n"]) for r in got} == best(rows) and len(got) == len(best(rows))


def test_entries_of_one_run_are_not_moved(spark):
    rows = [(random.Random(i).randbytes(32), 1, i, i) for i in range(4000)]
    df = spark.createDataFrame(rows + rows[:10], "key binary, chars long, doc_id long, row long").repartition(4)
    runs = exact.flush(df).cache()
    heads = [(r["run"], bytes(r["filter"])) for r in runs.where("key is null").collect()]
    marked = exact._contested(runs, heads).where("contested").count()
    assert marked < 200
