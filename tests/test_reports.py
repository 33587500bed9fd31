"""The report and the claims page on a run of four questions."""

import pytest

from quillon.sources import reports

GRADED = "qid string, question string, side string, category string, audience string, expected string, verdict string, coverage double, incorrect array<string>, n_incorrect int, declined boolean, refused boolean, refusal_stage string, answer string"
CLAIMS = "qid string, claims array<struct<claim:string,verdict:string,note:string,cited:array<int>,supported_by:array<int>>>"


@pytest.fixture
def parts(spark):
    graded = spark.createDataFrame(
        [
            ("q1", "One?", "rag", "A", "curious", "answer", "correct", 1.0, [], 0, False, False, None, "yes"), ("q1", "One?", "llm", "A", "curious", "answer", "partial", 0.5, ["a | b"], 1, False, False, None, "so"),
            ("q2", "Two?", "rag", "B", "expert", "answer", "incorrect", None, ["x"], 1, False, True, "score_gate", ""), ("q2", "Two?", "llm", "B", "expert", "answer", "correct", 1.0, [], 0, False, False, None, "z"),
            ("q3", "Three?", "rag", "H", "expert", "refuse", "declined", None, [], 0, True, True, "evidence_check", ""), ("q3", "Three?", "llm", "H", "expert", "refuse", "answered_from_memory", None, [], 0, False, False, None, "line\nbreak"),
            ("q4", "Four?", "rag", "A", "expert", "answer", "partial", 0.5, [], 0, False, False, None, "w"), ("q4", "Four?", "llm", "A", "expert", "answer", "correct", 1.0, [], 0, False, False, None, "w"),
        ], GRADED)
    claims = spark.createDataFrame(
        [("q1", [("c <1>", "supported", None, [1], [1, 2]), ("c2", "partial", "near", [2], [3])]), ("q4", [("c3", "supported", "", [], [1])])], CLAIMS)
    results = spark.createDataFrame([("q1", 1, True), ("q2", None, False), ("q4", 3, None)], "qid string, gold_rank int, evidence_found boolean")
    timings = spark.createDataFrame([("total", 1.0), ("total", 3.0), ("total", 9.5), ("llm_total", 0.5)], "stage string, seconds double")
    return graded, claims, results, timings


def test_markdown(parts):
    text = reports.evaluation_markdown({"run_id": "20260101-0900-x", "strategy": "vector"}, *parts)
    for line in (
        "# Evaluation run `20260101-0900-x`", "strategy `vector` · 4 questions (3 answerable, 1 should be refused)", "| Fully correct answers | 1/3 (33%) | 2/3 (67%) |", "| Partially correct | 1/3 (33%) | 1/3 (33%) |",
        "| Key-fact coverage (mean) | 50% | 83% |", "| Answers with an incorrect claim | 1/3 (33%) | 1/3 (33%) |", "| Faithfulness (claims fully supported) | 2/3 (67%) | n/a |", "| Fully faithful answers | 1/2 (50%) | n/a |",
        "| Citation accuracy | 1/2 (50%) | n/a |", "| Correct refusals | 1/1 (100%) | 0/1 (0%) |", "| False refusals | 1/3 (33%) | 0/3 (0%) |", "| Latency p50 / p95 | 3.00s / 9.50s | 0.50s / 0.50s |",
        "Targets: faithfulness ≥ 90% → **NOT MET** · p95 ≤ 8s → **NOT MET**", "| A | 2 | 1 / 1 | 1 / 1 | 75% | 75% | 0 | 1 |", "| q3 | H | Three? | refused (evidence_check) | **answered from memory**: line break |",
        "- Gold document ranked first: 1/3 (33%)", "- Gold document in the first five: 2/3 (67%) · MRR 0.44", "- The answer's text in one of the first five: 1/2 (50%)", "| total | 3.00s | 9.50s |",
        "| q1 | A | curious | 1 | yes | correct | 50% (2) | partial | LLM wrong: a / b |", "| q2 | B | expert | **miss** | **no** | incorrect | - | correct | RAG refused at score_gate · RAG wrong: x |", "| q4 | A | expert | 3 | - | partial | 100% (1) | correct |  |",
    ):
        assert line in text.split("\n"), line
    with pytest.raises(ValueError, match="more than 2 rows"):
        reports.evaluation_markdown({"run_id": "x"}, *parts, limit=2)


def test_claims_page(spark, parts):
    claims = parts[1]
    rows = claims.selectExpr("*", "'<q>' AS question", "'a & b' AS answer", "array(named_struct('n', 1, 'title', 'T <1>', 'section', null, 'score', 0.5D, 'doc_id', 7), named_struct('n', 2, 'title', 'U', 'section', 'S', 'score', 0.25D, 'doc_id', 8)) AS sources", "array(8) AS gold")
    page = reports.claims_page(rows)
    assert "<li class='ok'>c &lt;1&gt; <i>supported · cited 1 · supported by 1, 2</i></li>" in page
    assert "<li class='part'>c2 <i>partial (near) · cited 2 · supported by 3 · citation mismatch</i></li>" in page
    assert "<li class='ok'>c3 <i>supported · cited - · supported by 1</i></li>" in page
    assert "<li>[1] 0.50 T &lt;1&gt; </li><li>[2] 0.25 U S ✓</li>" in page and "&lt;q&gt;" in page and "a &amp; b" in page
    with pytest.raises(ValueError, match="more than 1 rows"):
        reports.claims_page(rows, limit=1)
