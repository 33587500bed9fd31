"""Fill-in-the-middle against plain Python, and round trips."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.llm import infill, queries

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n string, form int, output binary, _pieces int"


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(3)
    alphabet = ["a", "B", "z", " ", "\n", "é", "ß", "日", "😀", "<", ">", "P", "1", "'", "́", "\x00", "\r", "{", "@", "["]
    texts = [None, "", " ", "a", "😀", "<P>", "x<M>y", "a" * 5000, "😀" * 1500, "ab " * 3000, "<S", "P>", "<" * 700, "é" * 513 + "a"]
    texts += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 100, 511, 512, 513, 1024, 1025, 3000) for _ in range(6)]
    return texts


@pytest.mark.parametrize("chars", [1, 2, 8, 512])
def test_odd_texts(spark, chars):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a null id"), (-7, "negative"), (5, "repeated"), (5, "repeated")]
    df = spark.createDataFrame([(*r, "x", 1, b"x", 3) for r in rows], SCHEMA)
    found = infill.fill_in_middle(df, chars=chars).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    got = sorted((str(r["doc_id"]), r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found)
    assert got == sorted((str(i), t or "", *brute(i, t)) for i, t in rows)
    assert all(r["back"] == r["text"] for r in found)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_the_owning_pieces_are_scanned_again(spark):
    """Ranks are routed by the counts alone: each owner holds its cut, and the counts add up."""
    text = "ab cd, efg hij klmnop q " * 9
    df = spark.createDataFrame([(text,)], "text string").select(infill.overlapping(infill.text_chunks(F.col("text"), 7)).alias("o"))
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    starts = [0]
    for t in tokens:
        starts.append(starts[-1] + len(t))
    ranks = [0, 17, len(tokens) - 1, len(tokens)]
    routed = df.select(F.array(*infill.owners(infill.chunk_counts(F.col("o")), [F.lit(r) for r in ranks])).alias("own"), infill.chunk_counts(F.col("o")).alias("n")).first()
    assert sum(routed["n"]) == len(tokens)
    for r, own in zip(ranks, routed["own"], strict=True):
        assert own["found"] == (r < len(tokens))
        if own["found"]:
            assert own["piece"] == starts[r] // 7 and own["before"] == sum(s < 7 * own["piece"] for s in starts[:-1])


def test_whole_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in queries.op12_fill_in_middle(spark, DIR).collect():
        n, form, prefix, middle, output = brute(r["doc_id"], docs[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, prefix, middle, sha(output), sha(docs[r["doc_id"]] or ""))
