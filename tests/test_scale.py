"""What keeps operators whole and bounded where tables are large."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions.arrow import sliced
from quillon.functions.numbers import rounded
from quillon.operators import answering as A
from quillon.operators import chunking as C
from quillon.operators import retrieval as R
from quillon.plans import evaluation_queries as EQ
from quillon.sources import providers as P

DIR = "/root/testdata/sf0.001"
CHUNKS = "chunk_id long, ord long, text string"


def rows_of(df, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_bm25_scores_where_the_chunk_is(spark):
    texts = ["red fox", "fox fox blue", "blue", "", None, "red red red fox", "green", "red fox"]
    chunks = spark.createDataFrame([(10 * i, i, t) for i, t in enumerate(texts)], CHUNKS).repartition(3)
    queries = spark.createDataFrame([(1, "red fox fox"), (2, "unknown words"), (3, "the of"), (4, ""), (5, "blue green")], "qid long, text string")
    near = R.bm25_topk(queries, chunks, 4)
    assert "hashpartitioning(chunk_id" not in near._jdf.queryExecution().toString()  # no posting is moved
    names = ["qid", "chunk_id", "ord", "rank", "score"]
    assert rows_of(near.select(names)) == rows_of(R.bm25_topk(queries, chunks, 4, few=0).select(names))


def test_hits_are_found_once(spark):
    plan = EQ._hits(spark, DIR)._jdf.queryExecution().toString()
    assert "parquet" not in plan.lower()  # kept: each further use reads the few hits, not the corpus
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "qid long, question string")
    none = spark.createDataFrame([], "qid long, rank int, title string, year long, page long, section string, text string, score double")
    assert {r["route"] for r in A.answer_questions(asked, none, EQ.stub_grader, EQ.stub_writer).collect()} == {"refuse:score_gate"}


def test_slices_weigh_each_row():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 100, "b", None, "c" * 5000])], names=["i", "t"])
    parts = list(sliced([batch], 150))
    assert [p.num_rows for p in parts] == [3, 1]
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert list(sliced([batch.slice(0, 0)])) == []


def test_rounding_is_that_of_sql(spark):
    con = duckdb.connect()
    pairs = [(199, 40), (1029, 120), (1649, 200), (5, 2), (7, 3), (0, 9)]
    got = spark.createDataFrame(pairs, "a int, b int").select(rounded(F.col("a") / F.col("b"), 2)).collect()
    assert [r[0] for r in got] == [con.execute("SELECT round(?::INT / ?::INT, 2)", p).fetchone()[0] for p in pairs]


def test_pieces_leave_in_small_batches(spark):
    text = "ab " * 40_000
    held = []

    def encode(t):
        held.append(len(t))
        return [(1, p) for p in t.split()]

    sizes = C.token_pieces(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").coalesce(1), encode)
    counted = sizes.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in counted) == 20 * 40_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([text] * 20)], names=["doc_id", "text"])
    assert max(b.num_rows for b in sliced([batch], C.PIECE_BYTES)) <= 2  # before, all 20 texts' pieces were held at once
    last = sizes.where("doc_id = 19 and pos = 39999").first()
    assert (last["token_id"], last["piece"]) == (1, "ab")


def test_lines_of_a_row_are_its_segments(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, "\n"), (4, "one")], "doc_id long, text string")
    segments = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_no", "text"))
    assert rows_of(docs.select("doc_id", C.full_text_of_lines(F.col("text")))) == rows_of(C.full_texts(segments))


def test_embedded_in_place(spark):
    chunks = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, ""), (4, "a b c")], "chunk_id long, text string")
    here = P.embedded_in_place(chunks, P.stub_embedder)
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()  # no text is moved
    there = P.embedded(chunks.withColumnRenamed("chunk_id", "id"), None, P.stub_embedder)
    assert sorted((r["chunk_id"], r["v"]) for r in here.collect()) == sorted((r["id"], r["v"]) for r in there.collect())
