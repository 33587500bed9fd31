"""Round trips of sources and sinks, the streaming index and the rate budget."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import chunking, indexing
from quillon.sources import io
from quillon.streaming import state


def test_manifest(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"documents": [{"id": "a", "title": "T", "authors": ["X", "Y"], "year": 1999, "format": "pdf"}]}))
    r = io.manifest(spark, str(path)).first()
    assert (r["id"], r["authors"], r["year"], r["notes"]) == ("a", ["X", "Y"], 1999, None)


def test_chunk_file_round_trip(spark, tmp_path):
    names = "doc_id title authors year era source_type document_type url chunk_index page section".split()
    row = ("a::0000", "text", "a", "T", "X", 1, "e", "s", "d", "u", 0, 2, "S")
    df = spark.createDataFrame([row], "id string, text string, doc_id string, title string, authors string, year int, era string, source_type string, document_type string, url string, chunk_index int, page int, section string")
    io.write_chunks(df, str(tmp_path / "c"))
    io.write_chunks(df, str(tmp_path / "c"))
    got = io.read_chunks(spark, str(tmp_path / "c")).select("id", "text", *[f"metadata.{n}" for n in names]).collect()
    assert [tuple(r) for r in got] == [row]


def test_raw_files_and_dispatch(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"title": "W", "text": "wiki", "revision_id": 5}))
    (tmp_path / "h.html").write_text("<p>x</p>")
    raw = io.raw_files(spark, str(tmp_path))
    loaders = {"json": lambda df: df.select("doc_id", io.wiki_text(F.col("content"))[1]), "html": lambda df: df.select("doc_id", F.col("content").cast("string").alias("text"))}
    assert sorted(tuple(r) for r in io.load_segments(raw, loaders).collect()) == [("h", "<p>x</p>"), ("w", "wiki")]


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z int")
    assert io.markdown_table(df) == "| x | y | z |\n|---|---|---|\n| a/b | 0.500 | n/a |"
    claims = spark.createDataFrame([("q", "1 < 2 & 3", "supported", None)], "qid string, claim string, verdict string, note string")
    assert "1 &lt; 2 &amp; 3" in io.html_claims(claims)
    assert io.viewer_payload(spark.createDataFrame([("</script>",)], "t string")).first()[0] == '{"t":"<\\/script>"}'


def test_rolling_budget():
    assert state.admitted([(0, 60), (1, 30), (2, 20), (3, 200)], 100) == pytest.approx([0, 1, 60.1, 120.2])
    assert state.admitted([(0, 500)], 100) == [0]


def test_paced_stream(spark, tmp_path):
    spark.createDataFrame([(1, 0.0, 60), (1, 1.0, 30), (1, 2.0, 20), (2, 0.0, 90)], "key long, ts double, tokens long").write.parquet(f"{tmp_path}/calls")
    stream = state.paced(spark.readStream.schema("key long, ts double, tokens long").parquet(f"{tmp_path}/calls"), 100)
    stream.writeStream.format("memory").queryName("paced").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["key"], r["ts"], r["start"]) for r in spark.table("paced").collect()) == [(1, 0.0, 0.0), (1, 1.0, 1.0), (1, 2.0, 60.1), (2, 0.0, 0.0)]


def test_upsert(spark):
    rows = spark.createDataFrame([(1, "old"), (2, "keep"), (3, "gone")], "doc_id int, text string")
    new = spark.createDataFrame([(1, "new")], "doc_id int, text string")
    gone = spark.createDataFrame([(3,)], "doc_id int")
    assert sorted(tuple(r) for r in indexing.upserted(rows, new, gone).collect()) == [(1, "new"), (2, "keep")]


def test_unknown_formats_and_long_reports_fail(spark, tmp_path):
    (tmp_path / "x.odd").write_text("x")
    with pytest.raises(ValueError, match="odd"):
        io.load_segments(io.raw_files(spark, str(tmp_path)), {"json": lambda df: df})
    with pytest.raises(ValueError, match="more than 3 rows"):
        io.markdown_table(spark.range(4), 3)
    assert io.markdown_report("R", {"A": spark.range(1)}) == "# R\n\n## A\n\n| id |\n|---|\n| 0 |\n"


def test_chunk_file_is_counted(spark, tmp_path):
    assert io.chunk_count(spark, str(tmp_path / "none")) == 0 and not io.index_ready(spark, str(tmp_path / "none"))


def test_rebuild_drops_everything(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "index"))
    state.rebuilt(spark, str(tmp_path / "index"), str(tmp_path / "not-there"))
    assert not (tmp_path / "index").exists()
