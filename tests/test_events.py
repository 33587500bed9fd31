"""Events of answers, their numbers in a stream, and builds under a lease."""

import datetime as dt
import threading

import pytest

from quillon.operators.answering import REFUSAL
from quillon.sources.build import Step, build_once, ordered
from quillon.streaming import admission, events

ANSWERS = "session long, ts timestamp, qid long, route string, answer string"
AT = dt.datetime(2024, 1, 1)


def test_events_of_each_route(spark):
    rows = [(1, AT, 1, "generate", " Two  words.\n"), (1, AT, 2, "refuse:score_gate", REFUSAL), (1, AT, 3, "refuse:evidence_check", REFUSAL), (1, AT, 4, "generate", None)]
    got = {}
    for r in events.answer_events(spark.createDataFrame(rows, ANSWERS)).orderBy("qid", "seq").collect():
        got.setdefault(r["qid"], []).append((r["seq"], r["type"], r["node"], r["text"]))
    assert got[1] == [(0, "stage", "retrieve", None), (1, "stage", "grade_evidence", None), (2, "token", "generate", " "), (3, "token", "generate", "Two  "), (4, "token", "generate", "words.\n"), (5, "stage", "generate", None), (6, "final", None, " Two  words.\n")]
    assert "".join(t for _, kind, _, t in got[1] if kind == "token") == got[1][-1][3]
    assert [(k, n) for _, k, n, _ in got[2]] == [("stage", "retrieve"), ("stage", "refuse"), ("final", None)]
    assert [(k, n) for _, k, n, _ in got[3]] == [("stage", "retrieve"), ("stage", "grade_evidence"), ("stage", "refuse"), ("final", None)]
    assert got[4][-1] == (3, "final", None, "")


def test_numbers_go_on_and_a_replay_gives_the_same(spark, tmp_path):
    batches = [[(1, AT, 10, "generate", "a b"), (2, AT, 20, "refuse:score_gate", "no")], [(1, AT, 11, "generate", "c"), (1, AT, 10, "generate", "a b")]]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", admission.STORE)

    def run(folder):
        for rows in batches:
            spark.createDataFrame(rows, ANSWERS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = events.event_stream(spark.readStream.schema(ANSWERS).parquet(f"{folder}/in"))
            stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select("session", "seq", "qid", "type", "text").collect())

    try:
        one, two = run(tmp_path / "one"), run(tmp_path / "two")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert one == two
    assert [s for session, s, *_ in one if session == 1] == list(range(11)) and [q for session, _, q, *_ in one if session == 1] == [10] * 6 + [11] * 5
    assert [s for session, s, *_ in one if session == 2] == [0, 1, 2]


def test_steps_in_order():
    steps = [Step("c", print, after=("a", "b")), Step("a", print), Step("b", print, after=("a",))]
    assert [s.name for s in ordered(steps)] == ["a", "b", "c"]
    for bad in ([Step("a", print, after=("a",))], [Step("a", print, after=("x",))]):
        with pytest.raises(ValueError):
            ordered(bad)


def test_one_of_two_builds(spark, tmp_path):
    done, said, results = [], [], []
    gate = threading.Barrier(2)

    def index():
        done.append(1)
        spark.range(3).write.parquet(f"{tmp_path}/index")

    def fails():
        raise OSError("no network")

    steps = [Step("view", fails, after=("index",)), Step("index", index, fatal=True)]

    def run():
        gate.wait()
        results.append(build_once(spark, str(tmp_path), steps, lambda: (tmp_path / "index/_SUCCESS").exists(), said.append))

    both = [threading.Thread(target=run) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert done == [1] and sorted(results) in (["built", "waited"], ["built", "ready"]) and said == ["index", "view", "view failed: no network"]
    assert build_once(spark, str(tmp_path), steps, lambda: True) == "ready" and not (tmp_path / "_building").exists()


def test_a_fatal_step_gives_the_lease_back(spark, tmp_path):
    def fails():
        raise OSError("x")

    with pytest.raises(OSError, match="x"):
        build_once(spark, str(tmp_path), [Step("a", fails, fatal=True), Step("b", print)], lambda: False, lambda s: None)
    (tmp_path / "_building").touch()  # a builder that is lost
    assert build_once(spark, str(tmp_path), [], lambda: False, lambda s: None, patience=-1) == "built"
