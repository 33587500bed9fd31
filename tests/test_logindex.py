"""The log-structured index: first runs, changes, deletions, compaction, killed and concurrent writers, streams."""

import os

import pytest
from pyspark.sql import functions as F

from quillon.streaming.logindex import Conflict, LogIndex, index_stream

SCHEMA = "doc_id long, text string"
CUT = []


def chunker(df):
    CUT.append(sorted(r[0] for r in df.select("doc_id").collect()))
    return df.select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "chunk"))


@pytest.fixture
def index(spark, tmp_path):
    CUT.clear()
    return LogIndex(spark, str(tmp_path / "index"), chunker, most=3)


def held(index, version=None):
    return sorted(tuple(r) for r in index.chunks(version).select("doc_id", "n", "chunk").collect())


def docs(index, *rows):
    return index.spark.createDataFrame(list(rows), SCHEMA)


def test_an_empty_folder(index):
    assert index.manifest()["version"] == 0 and index.state().count() == 0 and held(index) == []
    assert index.compact()["version"] == 0 and index.vacuum() == []
    assert index.upsert(docs(index))["version"] == 0
    index.upsert(docs(index, (1, "a b"), (2, "c")))
    assert held(index) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_changed_new_and_vanished_documents(index):
    index.upsert(docs(index, (1, "a b"), (2, "c"), (3, "d")), whole=True)
    CUT.clear()
    index.upsert(docs(index, (1, "a b"), (2, "c x"), (4, "e")), whole=True)
    assert CUT == [[2, 4]]
    assert held(index) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "x"), (4, 0, "e")]
    assert sorted(r["doc_id"] for r in index.state().collect()) == [1, 2, 4]
    assert held(index, 1) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")]  # an old version stays readable
    before = index.manifest()
    assert index.upsert(docs(index, (1, "a b"), (2, "c x"), (4, "e")), whole=True) == before
    index.upsert(docs(index, (4, None), (5, "f")))  # not the whole: a null text deletes, others stay
    assert sorted(r["doc_id"] for r in index.state().collect()) == [1, 2, 5]
    index.upsert(docs(index, (4, "e again")))
    assert (4, 1, "again") in held(index)


def test_compaction_and_vacuum(index):
    for n in range(6):
        index.upsert(docs(index, (n, f"text {n}"), (100, f"changes {n}")))
        assert len(index.manifest()["batches"]) <= 3
    index.upsert(docs(index, (0, None)))
    want = held(index)
    index.compact()
    manifest = index.manifest()
    assert len(manifest["batches"]) == 1 and held(index) == want
    at = f"{index.path}/state/{manifest['batches'][0]['id']}"
    rows = index.spark.read.parquet(at)  # a row a document, no tombstones
    assert rows.count() == rows.select("doc_id").distinct().count() == 6 and rows.where("fingerprint is null").count() == 0
    assert index.vacuum() and held(index) == want
    assert os.listdir(f"{index.path}/chunks") == [manifest["batches"][0]["id"]] and index.versions() == [manifest["version"]]


def test_a_killed_batch_leaves_the_old_version(index):
    index.upsert(docs(index, (1, "a")))
    want = held(index)
    broken = LogIndex(index.spark, index.path, lambda df: df.select("doc_id", F.lit(0).alias("n"), F.raise_error(F.lit("killed")).cast("string").alias("chunk")))
    with pytest.raises(Exception, match="killed"):
        broken.upsert(docs(index, (1, "b"), (2, "c")))
    unlisted = LogIndex(index.spark, index.path, chunker)
    unlisted._commit = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)  # both tables written, no manifest
    with pytest.raises(KeyboardInterrupt):
        unlisted.upsert(docs(index, (1, "b"), (2, "c")))
    assert held(index) == want and index.manifest()["version"] == 1
    index.upsert(docs(index, (1, "b"), (2, "c")))
    assert held(index) == [(1, 0, "b"), (2, 0, "c")]
    assert len(index.vacuum(keep=2)) == 2


def test_of_two_writers_one_commits(index):
    index.upsert(docs(index, (1, "a")))
    old = index.manifest()
    index.upsert(docs(index, (2, "b")))
    with pytest.raises(Conflict):
        index._commit(old, old["batches"], {})
    assert held(index) == [(1, 0, "a"), (2, 0, "b")]
    assert not [n for n in os.listdir(f"{index.path}/manifests") if n.startswith("_")]


def test_repeated_and_null_ids(index):
    index.upsert(docs(index, (1, "a"), (1, "b"), (None, "c"), (2, ""), (3, None)))
    assert held(index) == [(1, 0, "b"), (2, 0, "")]
    index.rebuild()
    assert index.state().count() == 0 and held(index) == []
    index.upsert(docs(index, (1, "b")))
    assert held(index) == [(1, 0, "b")]


def test_stream(index, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: index_stream(index, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/ck").start().awaitTermination()
    (tmp_path / "in/1.json").write_text('{"doc_id": 1, "text": "one"}\n{"doc_id": 2, "text": "two"}\n')
    run()
    (tmp_path / "in/2.json").write_text('{"doc_id": 1, "text": "one"}\n{"doc_id": 2, "text": null}\n{"doc_id": 3, "text": "three"}\n')
    run()
    assert held(index) == [(1, 0, "one"), (3, 0, "three")]
    before = index.manifest()
    assert index.upsert(docs(index, (9, "again")), source=("files", 1)) == before  # a batch that is sent again
    assert before["applied"] == {"files": 1}
