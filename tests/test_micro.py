"""Hand-computed cases that the test data does not contain."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions import text as T
from quillon.operators import analytics, answering, chunking, evaluation, indexing, limits, retrieval, sections
from quillon.operators import evaluation as E
from quillon.operators import sections as S


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def mapped(spark, values, f, kind="string"):
    return [r["out"] for r in column(spark, values, kind).select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_text(spark):
    cases = {"eﬃcient com-\nputer": "efficient computer", "a  b\nc\n\n\n\nd \n e": "a b c\n\nd e", "co­op": "coop", "a-\nb-\nc": "ab- c", "  x  ": "x", "été-\nà": "étéà"}
    assert mapped(spark, list(cases), T.clean_text) == list(cases.values())


def test_headings(spark):
    cases = {"1. Introduction": "1. Introduction", "15.2 Results here": "15.2 Results here", "16 Main Street": None, "XVI. Late Section": "XVI. Late Section", "IV. Abc": "IV. Abc", "Abstract:": "Abstract", "Conclusion.": "Conclusion", "3 x": None}
    assert mapped(spark, list(cases), T.heading_of) == list(cases.values())


def test_tokens(spark):
    assert mapped(spark, ["GPT-3 has 1.3B, cost $13,500. Don't"], T.tokens) == [["gpt-3", "1.3b", "cost", "13,500", "don't"]]


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["alpha beta beta gamma", "alpha delta", "alpha gamma gamma", "alpha alpha beta epsilon", "alpha zeta", "eta theta"]
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts, 1)], "chunk_id long, ord long, text string")


@pytest.mark.parametrize(
    "query,want",
    [
        ("gamma", [0.495899, 0, 0.824113, 0, 0, 0]),
        ("gamma gamma", [0.991799, 0, 1.648227, 0, 0, 0]),
        ("alpha", [0.168015, 0.229525, 0.194011, 0.251243, 0.229525, 0]),
        ("beta delta", [0.741549, 1.497479, 0, 0.495899, 0, 0]),
    ],
)
def test_bm25_scores(spark, chunks, query, want):
    q = spark.createDataFrame([(1, query)], "qid long, text string")
    got = {r["chunk_id"]: r["score"] for r in retrieval.bm25_topk(q, chunks, 6).collect()}
    assert [got[i] for i in range(1, 7)] == pytest.approx(want, abs=1e-6)


def test_bm25_fills_with_the_corpus_start(spark, chunks):
    q = spark.createDataFrame([(1, "nope"), (2, "alpha")], "qid long, text string")
    got = sorted((r["qid"], r["rank"], r["chunk_id"]) for r in retrieval.bm25_topk(q, chunks, 2).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 4), (2, 2, 2)]


def test_rrf(spark):
    def fused(vector, bm25, w):
        rows = [(1, n, c, i) for n, l in (("vector", vector), ("bm25", bm25)) for i, c in enumerate(l, 1)]
        df = spark.createDataFrame(rows, "qid long, list string, chunk_id string, rank int")
        return [(r["chunk_id"], round(r["score"], 6)) for r in retrieval.rrf(df, {"vector": w, "bm25": 1 - w}).orderBy("rank").collect()]

    assert fused("ABC", "DCA", 0.5) == [("A", 0.016133), ("C", 0.016001), ("D", 0.008197), ("B", 0.008065)]
    assert fused("A", "B", 0.5) == [("A", 0.008197), ("B", 0.008197)]
    assert fused("A", "B", 1.0) == [("A", 0.016393), ("B", 0.0)]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        retrieval.retrieve(None, None, "hybrid")


def test_citations(spark):
    assert mapped(spark, ["x [2][1] y [7] [2] [0] [03]"], lambda c: T.citations(c, F.lit(5))) == [[1, 2, 3]]


def test_score_gate(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    hits = spark.createDataFrame([(1, 0.35), (2, 0.3499)], "qid long, score double")
    assert [(r["top_score"], r["passes"]) for r in answering.score_gate(q, hits).orderBy("qid").collect()] == [(0.35, True), (0.3499, False), (0.0, False)]


def test_p95_and_medians(spark):
    sizes = {1: 1, 2: 2, 10: 10, 11: 10, 30: 28, 34: 32, 50: 48}
    assert mapped(spark, [[float(i) for i in range(1, n + 1)] for n in sizes] + [[]], N.p95, "array<double>") == [*map(float, sizes.values()), 0.0]
    assert mapped(spark, [[1, 2, 3, 4]], N.upper_median, "array<int>") == [3]


def test_histogram_edges(spark):
    assert mapped(spark, [-5.0, 0.0, 24.99, 25.0, 699.0, 700.0, 900.0], lambda v: N.edge_bin(v, 0, 700, 28), "double") == [0, 0, 0, 1, 27, 27, 27]


def test_faithfulness(spark):
    claims = [("supported", [1], [1]), ("partial", [2], [2, 3]), ("unsupported", [1], []), ("supported", [], [1])]
    df = spark.createDataFrame([(1, claims), (2, [])], "qid int, claims array<struct<verdict:string,cited:array<int>,supported_by:array<int>>>")
    a, b = evaluation.faithfulness(df).orderBy("qid").collect()
    assert tuple(a)[1:] == (4, 0.5, 0.75, pytest.approx(2 / 3), 1)
    assert tuple(b)[1:] == (0, None, None, None, 0)


def test_coverage(spark):
    df = spark.createDataFrame([(1, [True, False], 4), (2, [True, True, True], 2), (3, [], 0)], "i int, f array<boolean>, n int")
    assert [r["c"] for r in df.select("i", evaluation.coverage(F.col("f"), F.col("n")).alias("c")).orderBy("i").collect()] == [0.25, 1.0, None]


def test_changed_and_removed(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "doc_id string, fingerprint string")
    state = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_id string, fingerprint string")
    assert sorted(r["doc_id"] for r in indexing.changed_docs(now, state).collect()) == ["b", "d"]
    assert [r["doc_id"] for r in indexing.removed_docs(now, state).collect()] == ["c"]


def test_usage_caps(spark):
    rows = spark.createDataFrame([(i, s, "d", i) for i, s in enumerate(["s1", "s1", "s1", "s2", "s2"])], "request_id int, session string, day string, ts int")
    got = [r["outcome"] for r in limits.usage_caps(rows, 2, 3).orderBy("request_id").collect()]
    assert got == ["accept", "accept", "session_cap", "accept", "day_cap"]


def test_chunks_cover_the_text_and_keep_their_limits():
    text = "\n\n".join(" ".join(f"Sentence {i} of part {p}, with words; and more." for i in range(40)) for p in range(9)) + "\n\n" + "x" * 9000
    chunks = chunking.split_text(text, 300, 45)
    covered = set()
    for a, b in chunks:
        assert chunking.count_tokens(text[a:b]) <= 300 and text[a:b].strip() == text[a:b]
        covered |= set(range(a, b))
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)
    for (_, b), (c, _) in zip(chunks, chunks[1:], strict=False):
        assert chunking.count_tokens(text[c:b]) <= 45
    assert [a for a, _ in chunks] == sorted(a for a, _ in chunks)
    assert chunking.split_text("") == []


def test_wiki_sections(spark):
    text = "Lead.\n== One ==\nA\n=== Sub ===\nB\n== References ==\nC\n=== Deep ===\nD\n== Two ==\n\n== Three ==\nE"
    df = spark.createDataFrame([(1, text), (2, "=== Early ===\nx")], "doc_id long, text string")
    got = [(r["doc_id"], r["section"], r["text"]) for r in sections.wiki_sections(df).orderBy("doc_id", "seg_no").collect()]
    assert got == [(1, "Introduction", "Lead."), (1, "One", "A"), (1, "One > Sub", "B"), (1, "Three", "E"), (2, "Early", "x")]


def test_html_sections(spark):
    body = "This paragraph has well over forty characters of text in it."
    html = f"<html><nav><p>{body}</p></nav><h2>Head</h2><p>{body}<p>{body} <a href=x>{body}{body}</a></p><p><b>Bold title</b></p><ul><li>{body}<p>{body}</p></li></ul><td>short</td></html>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r["section"], r["text"]) for r in sections.html_sections(sections.html_blocks(df)).orderBy("seg_no").collect()]
    assert got[0] == ("Head", body)
    assert got[1][0] == "Bold title" and got[1][1].startswith(body)


def test_page_segments(spark):
    blocks = [(1, p, 0, f"Journal page {p}") for p in range(6)] + [(1, 0, 1, "1. Introduction"), (1, 0, 2, "Text one."), (1, 1, 1, "12 - 14"), (1, 1, 2, "Text two."), (1, 3, 1, "References"), (1, 4, 1, "[1] x")]
    df = spark.createDataFrame(blocks, "doc_id long, page int, block_no int, text string")
    got = [(r["seg_no"], r["page"], r["section"], r["text"]) for r in sections.page_segments(df).orderBy("seg_no").collect()]
    assert got == [(0, 0, "1. Introduction", "1. Introduction\n\nText one."), (1, 1, "1. Introduction", "Text two.")]


def test_display_clean(spark):
    text = "[T (1990) | S]\nx {\\displaystyle a_{b} + {c}} y 1 2 3 4 5 6 7 z"
    assert mapped(spark, [text], T.display_clean) == ["x y … z"]


def test_scale_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "i int, x double, y double")
    assert [tuple(r) for r in analytics.scale01(rows, ["x", "y"]).orderBy("i").collect()] == [(1, 0.0, None), (2, 1.0, None)]


def test_answers_ask_providers_for_gated_rows_only(spark, tmp_path):
    log = str(tmp_path / "asked")

    def grader():
        def grade(question, context):
            with open(log, "a") as f:
                f.write(question + "\n")
            return question != "weak", "why"

        return grade

    q = spark.createDataFrame([(1, "good"), (2, "weak"), (3, "off")], "qid long, question string")
    hits = spark.createDataFrame([(i, 1, 7, "T", 2000, 0, "", "body", s) for i, s in ((1, 0.9), (2, 0.5), (3, 0.1))], "qid long, rank int, chunk_id long, title string, year int, page int, section string, text string, score double")
    got = {r["question"]: (r["route"], r["answer"], r["refusal_stage"]) for r in answering.answer_questions(q, hits, grader, lambda: lambda a, c: "yes [1]").collect()}
    assert got["good"] == ("generate", "yes [1]", "")
    assert got["weak"][0::2] == ("refuse:evidence_check", "evidence_check") and got["off"][0::2] == ("refuse:score_gate", "score_gate")
    with open(log) as f:
        assert sorted(f.read().split()) == ["good", "weak"]


def test_plans(spark):
    """Top-k prunes before the shuffle; filters and columns reach the scan."""
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("ord"), F.col("label").cast("double").alias("score"))
    plan = retrieval.ranked(v.where("qid > 5"), 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "PushedFilters: [IsNotNull(vec_id), GreaterThan(vec_id,5)]" in plan and "ReadSchema: struct<vec_id:bigint,label:int>" in plan


def test_vectors_of_several_lengths(spark):
    """A block whose first query is short loses no other query."""
    queries = spark.createDataFrame([(0, [1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "qid long, v array<double>")
    vectors = spark.createDataFrame([(10, [2.0, 0.0]), (11, [1.0, 1.0]), (12, [3.0]), (13, [0.0, 0.0]), (14, None)], "chunk_id long, v array<double>")
    got = sorted((r["qid"], r["rank"], r["chunk_id"]) for r in retrieval.vector_topk(queries, vectors, 2).collect())
    assert got == [(0, 1, 12), (1, 1, 10), (1, 2, 11), (2, 1, 11), (2, 2, 10)]


def test_vector_search_keeps_a_running_best(spark):
    rows = [(i, [1.0, i / 100]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "chunk_id long, v array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    got = retrieval.vector_topk(spark.createDataFrame([(0, [1.0, 0.0])], "qid long, v array<double>"), vectors, 3).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2]


def test_holders(spark):
    docs = spark.createDataFrame([(1, "xx a bb c d ee yy"), (2, "a bb c dd"), (3, None), (4, "zza bb c d e"), (5, "short"), (6, "a bb c x c d e a bb c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a bb c d e"), (2, "short"), (3, "b c"), (4, ""), (5, None)], "qid long, item string")
    assert sorted(tuple(r) for r in evaluation.holders(docs, items).collect()) == [(1, 1), (1, 4), (1, 6), (2, 5), (3, 1), (3, 2), (3, 4), (3, 6)]


def test_stored_index_reads_the_asked_parts_only(spark, tmp_path):
    chunks = spark.createDataFrame([(i, i, f"word{i} shared word{i % 7}") for i in range(200)], "chunk_id long, ord long, text string")
    queries = spark.createDataFrame([(0, "word3 shared"), (1, "nothing")], "qid long, text string")
    retrieval.store_index(chunks, str(tmp_path / "i"))
    found = retrieval.stored_topk(spark, str(tmp_path / "i"), queries)
    assert sorted(map(tuple, found.select("qid", "chunk_id", "rank").collect())) == sorted(map(tuple, retrieval.bm25_topk(queries, chunks).select("qid", "chunk_id", "rank").collect()))
    assert "PartitionFilters: [part" in retrieval.stored_postings(spark, str(tmp_path / "i"), [1, 2])._jdf.queryExecution().toString()


def test_chunks_by_a_tokenizer(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    length = chunking.vocabulary_length(path)
    text = "The quick brown fox jumps over the lazy dog. " * 200
    got = chunking.chunk_docs(spark.createDataFrame([(1, text)], "doc_id long, full_text string"), 300, 45, length).collect()
    assert len(got) > 5 and all(0 < r["n_tokens"] == length(r["text"]) <= 300 for r in got)


def test_pages_count_whether_or_not_anything_is_kept(spark):
    """Six pages, the first two with a running header and a number only: the references may start on the third."""
    rows = [(1, p, 0, "A running header") for p in range(6)] + [(1, p, 1, str(p)) for p in range(6)]
    rows += [(1, 2, 2, "Kept, on page two"), (1, 2, 3, "References"), (1, 2, 4, "[2] Someone"), (1, 4, 2, "Later text")]
    rows += [(2, p, 0, f"Text of page {'abcdef'[p]}") for p in range(6)] + [(2, 1, 1, "References")]  # too early: a table of contents
    got = S.page_segments(spark.createDataFrame(rows, "doc_id long, page long, block_no long, text string")).orderBy("doc_id", "seg_no").collect()
    assert [r["text"] for r in got if r["doc_id"] == 1] == ["Kept, on page two"]
    assert {r["page"] for r in got if r["doc_id"] == 2} == set(range(6))


@pytest.mark.parametrize("chars", [1 << 20, 12])
def test_holders_by_automaton(spark, monkeypatch, chars):
    monkeypatch.setattr(E, "AUTOMATON_CHARS", chars)
    texts = {1: "abc abcd\nx", 2: "", 3: None, 4: "zürich – abc", 5: "the end of it", 6: "abcabc"}
    items = [(1, "abc"), (2, "abcd\nx"), (3, ""), (4, None), (5, "rich –"), (6, "d"), (7, "abc"), (8, "not there"), (None, "abc")]
    docs = spark.createDataFrame([*texts.items(), (1, "abc")], "doc_id long, text string")
    got = E.holders(docs, spark.createDataFrame(items, "qid long, item string")).collect()
    want = {(q, d) for q, i in items if q and i for d, t in texts.items() if t and i in t}
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("place", [1 << 17, 3])
def test_percentiles_by_ranges(spark, monkeypatch, place):
    monkeypatch.setattr(E, "PLACE_ROWS", place)
    monkeypatch.setattr(E, "RANGES", 4)
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 5)) for _ in range(301)] + [("b", float(rng.randrange(4))) for _ in range(100)] + [("c", 2.5), ("d", None), ("e", 1.0), ("e", 1e12), ("e", 3.0)]
    got = {r["stage"]: (r["n"], r["p50"], r["p95"]) for r in E.latency_percentiles(spark.createDataFrame(rows, "stage string, seconds double")).collect()}
    for stage in "abce":
        own = sorted(s for g, s in rows if g == stage)
        assert got[stage] == (len(own), pytest.approx(statistics.median(own)), own[max(0, round(0.95 * len(own)) - 1)])
    assert "d" not in got


def test_cleaning_steps_are_left_out_only_where_they_change_nothing(spark):
    """Texts of odd characters, cleaned as by all steps; the plan deals blocks out by document, not by their keys."""
    draw = random.Random(5)
    odd = ["a", "B", "-", "\n", " ", "\t", "­", " ", "\x1c", "\x1f", "é", "é", " ", "\r", "ﬁ", "1", "."]
    texts = [*("".join(draw.choices(odd, k=draw.randrange(12))) for _ in range(3000)), "a-\nb-\nc", " a ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = T.replaced(F.translate(T.nfkc(F.col("text")), "­", ""), *T.CLEANING)
    white = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    wrong = df.select("text", T.clean_text(F.col("text")).alias("a"), plain.alias("b"), T.trimmed(F.col("text")).alias("c"), white.alias("d"))
    assert wrong.where("not (a <=> b) or not (c <=> d)").collect() == []
    blocks = spark.createDataFrame([(1, 0, 0, "x")], "doc_id long, page long, block_no long, text string")
    plan = S.page_segments(blocks)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert len(moved) == 6 and "LeftAnti" not in plan  # five of them deal keys and pages, one texts


def test_keywords_of_batches_are_those_of_the_expression(spark):
    """Found on the bytes of all texts at once; texts meet where one ends with a letter and the next begins with one."""
    import pyarrow as pa

    from quillon.functions.arrow import keywords

    draw = random.Random(9)
    odd = ["a", "B", "7", "-", ".", "'", ",", " ", "\n", "the", "é", "K", "İ", "ß", "\U0001f600", "AND", "_", "İ", "x-y"]
    texts = [*("".join(draw.choices(odd, k=draw.randrange(14))) for _ in range(3000)), "", None, "ab", "cd", ".e", "f.", "", "g", "-", "h", None]
    want = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", T.tokens(F.col("text")).alias("t")).collect()
    for array in (pa.array(texts, pa.string()), pa.array(["zz", *texts], pa.string()).slice(1)):
        row, codes, words = keywords(array)
        got = [[] for _ in texts]
        for r, w in zip(row.tolist(), words.take(pa.array(codes)).to_pylist(), strict=True):
            got[r].append(w)
        assert got == [r["t"] or [] for r in sorted(want)]
    assert [len(x) for x in keywords(pa.array([], pa.string()))] == [len(x) for x in keywords(pa.array([None, ""], pa.string()))] == [0, 0, 0]
    chunks = spark.createDataFrame([(1, 1, "a stone")], "chunk_id long, ord long, text string")
    assert "regexp_extract_all" not in retrieval.term_counts(chunks)._jdf.queryExecution().toString()
