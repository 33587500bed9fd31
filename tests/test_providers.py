"""Retries, pacing, the embedding cache and small helpers."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import answering, chunking, evaluation
from quillon.sources import io, providers


def test_waits():
    assert providers.wait_seconds("please try again in 2s.", 0) == pytest.approx(2.2)
    assert providers.wait_seconds("try again in 300ms", 0) == pytest.approx(0.33)
    assert providers.wait_seconds("no", 2) == 6.0


def test_retries():
    slept, left = [], [2]

    def call(x):
        if left[0]:
            left[0] -= 1
            raise RuntimeError("try again in 1s")
        return x

    assert providers.with_retries(call, sleep=slept.append)(7) == 7 and len(slept) == 2
    with pytest.raises(RuntimeError):
        providers.with_retries(lambda: 1 / 0 if False else (_ for _ in ()).throw(RuntimeError("x")), attempts=2, sleep=slept.append)()


def test_pacer():
    clock = [0.0]
    pacer = providers.Pacer(100, 60, now=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    for tokens in (60, 30, 20):
        pacer.admit(tokens)
    assert clock[0] == pytest.approx(60.1)


def test_embedding_cache(spark, tmp_path):
    log = str(tmp_path / "asked")

    def provider():
        embed = providers.stub_embedder(8)

        def logged(texts):
            with open(log, "a") as f:
                f.write("".join(t + "\n" for t in texts))
            return embed(texts)

        return logged

    chunks = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "two")], "id string, text string")
    first = providers.embedded(chunks.where("id <> 'a'"), None, provider).collect()
    cache = spark.createDataFrame([(r["key"], r["v"]) for r in first[:1]], "key string, v array<double>")
    got = providers.embedded(chunks, cache, provider).collect()
    assert sorted(r["id"] for r in got) == ["a", "b", "c"] and all(sum(x * x for x in r["v"]) == pytest.approx(1) for r in got)
    with open(log) as f:
        assert sorted(f.read().split()) == ["one", "two"]


def test_helpers(spark, tmp_path):
    df = spark.createDataFrame([(True, "no", "fb", True), (True, "no", None, True), (False, "yes", "fb", True), (True, "no", "fb", False)], "r boolean, a string, f string, u boolean")
    assert [r[0] for r in df.select(answering.shown_answer(*map(F.col, "rafu"))).collect()] == ["fb", "no", "yes", "no"]
    assert evaluation.audited("20250102-0900-plain-again", "20250101-0800-plain")
    answers = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string")
    assert [r["qid"] for r in evaluation.rejudge_work(answers, answers.where("qid = 'q1'"), ["q1", "q2"]).collect()] == ["q2"]
    texts = spark.createDataFrame([(1, "ab c")], "doc_id long, text string")
    assert [(r["pos"], r["token_id"], r["piece"]) for r in chunking.token_pieces(texts, lambda t: [(ord(w[0]), w) for w in t.split()]).collect()] == [(0, 97, "ab"), (1, 99, "c")]
    segs = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, 0, "C")], "doc_id long, seg_no int, text string")
    io.export_text(segs, 1, f"{tmp_path}/x")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/x").collect() if r["value"]] == ["A", "B"]
    assert spark.range(1).select(io.size_in_chars(F.lit(600), F.lit(4.236))).first()[0] == 2540


def test_baseline_timings_and_workers(spark):
    from quillon.operators import answering as A

    asked = spark.createDataFrame([(i, f"q{i}") for i in range(20)], "qid long, question string")
    results, seconds = A.timed({"baseline": lambda: A.baseline(asked, lambda: lambda q, c: q + "|" + c)}, spark)
    assert {r["answer"] for r in results["baseline"].collect()} == {f"q{i}|" for i in range(20)}
    assert [r["stage"] for r in seconds.collect()] == ["baseline"] and seconds.first()["seconds"] > 0
    assert A.in_workers(asked, 2).rdd.getNumPartitions() == 2
    assert A.refusal_rows(asked.limit(1)).first()["sources"] == []
