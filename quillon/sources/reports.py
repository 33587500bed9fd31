"""Reports of an evaluation run: figures come from Spark, a page is put together from summaries of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import escape_html
from quillon.operators import evaluation as E
from quillon.sources.io import _within


def share(n: int, d: int) -> str:
    return f"{n}/{d} ({100 * n / d:.0f}%)" if d else "n/a"


def _table(head: list[str], rows: list[list]) -> list[str]:
    clean = lambda v: str(v).replace("|", "/").replace("\n", " ")
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(map(clean, r)) + " |" for r in rows], ""]


def _percent(v) -> str:
    return "n/a" if v is None else f"{100 * v:.0f}%"


def evaluation_markdown(run: dict[str, str], graded: DataFrame, claims: DataFrame, results: DataFrame, timings: DataFrame, limit: int = 1000) -> str:
    """The report of a run of at most `limit` questions, as Markdown.

    run: run_id and settings to name. graded: a row for each question and side (rag, llm): qid, question, side, category,
    audience, expected, verdict, coverage, incorrect (array), n_incorrect, declined, refused, refusal_stage, answer.
    claims: (qid, claims) of the rag answers, as E.faithfulness takes them. results: as E.question_results gives them.
    timings: (stage, seconds); the stages total and llm_total are those of the two sides.
    """
    sides = {r["side"]: r for r in E.eval_summary(graded).collect()}  # two rows
    n, m = graded.where("side = 'rag'").agg(F.count_if(F.col("expected") == "answer"), F.count_if(F.col("expected") == "refuse")).first()
    faith = {r["qid"]: r for r in _within(E.faithfulness(claims), limit)}
    kept = claims.select(F.explode("claims").alias("c")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c.verdict") == "supported").alias("supported"), F.count_if(F.col("c.verdict") == "partial").alias("partial"), F.count_if(F.size("c.cited") > 0).alias("cited"),
        F.count_if((F.size("c.cited") > 0) & (F.col("c.verdict") != "unsupported") & F.arrays_overlap("c.cited", "c.supported_by")).alias("accurate"),
    ).first()
    whole = [f for f in faith.values() if f["faithfulness"] is not None]
    latency = {r["stage"]: r for r in E.latency_percentiles(timings).collect()}  # a row a stage
    found = E.retrieval_summary(results.join(graded.where("side = 'rag' and expected = 'answer'").select("qid"), "qid", "left_semi")).first()
    rag, llm = sides.get("rag"), sides.get("llm")
    both = lambda name, d: [share(rag[name] if rag else 0, d), share(llm[name] if llm else 0, d)]
    span = lambda s: f"{latency[s]['p50']:.2f}s / {latency[s]['p95']:.2f}s" if s in latency else "n/a"
    supported = kept["supported"] / kept["n"] if kept["n"] else None
    out = [f"# Evaluation run `{run['run_id']}`", "", " · ".join([f"{k} `{v}`" for k, v in run.items() if k != "run_id"] + [f"{n + m} questions ({n} answerable, {m} should be refused)"]), "", "## Headline", ""]
    out += _table(["Metric", "RAG", "LLM-only"], [
        ["Fully correct answers", *both("correct", n)], ["Partially correct", *both("partial", n)], ["Key-fact coverage (mean)", *[_percent(s["coverage"] if s else None) for s in (rag, llm)]],
        ["Answers with an incorrect claim", *both("hallucinated", n)], ["Faithfulness (claims fully supported)", share(kept["supported"], kept["n"]), "n/a"],
        ["Faithfulness with partly supported claims", share(kept["supported"] + kept["partial"], kept["n"]), "n/a"], ["Fully faithful answers", share(sum(f["faithfulness"] == 1 for f in whole), len(whole)), "n/a"],
        ["Citation accuracy", share(kept["accurate"], kept["cited"]), "n/a"], ["Correct refusals", *both("correct_refusals", m)], ["False refusals", *both("false_refusals", n)], ["Latency p50 / p95", span("total"), span("llm_total")],
    ])
    p95 = latency["total"]["p95"] if "total" in latency else None
    met = lambda v, good: "no figure" if v is None else "MET" if good else "NOT MET"
    out += [f"Targets: faithfulness ≥ {E.FAITHFULNESS_TARGET:.0%} → **{met(supported, supported is not None and supported >= E.FAITHFULNESS_TARGET)}** · p95 ≤ {E.P95_TARGET:.0f}s → **{met(p95, p95 is not None and p95 <= E.P95_TARGET)}**", ""]
    groups: dict[str, dict] = {"category": {}, "audience": {}}
    for r in _within(E.breakdown(graded), limit):
        groups[r["field"]].setdefault(r["key"], {})[r["side"]] = r
    for field, by in groups.items():
        rows = []
        for key in sorted(by, key=str):
            a, b = by[key].get("rag"), by[key].get("llm")
            each = lambda f, a=a, b=b: [f(x) if x else "n/a" for x in (a, b)]
            rows.append([key, (a or b)["n"], *each(lambda x: f"{x['correct']} / {x['partial']}"), *each(lambda x: _percent(x["coverage"])), *each(lambda x: x["wrong"])])
        out += [f"## By {field}", "", *_table([field, "n", "RAG correct / partial", "LLM correct / partial", "RAG coverage", "LLM coverage", "RAG wrong", "LLM wrong"], rows)]
    asked: dict = {}
    for r in _within(graded.orderBy("qid"), 2 * limit):
        asked.setdefault(r["qid"], {})[r["side"]] = r
    place = {r["qid"]: r for r in _within(results, limit)}
    refused, answered = [], []
    for qid, by in asked.items():
        a, b = by.get("rag"), by.get("llm")
        one = a or b
        if one["expected"] == "refuse":
            said = f"refused ({a['refusal_stage']})" if a and a["refused"] else "**answered**"
            other = "n/a" if not b else "declined" if b["declined"] else "**answered from memory**: " + (b["answer"] or "")[:90]
            refused.append([qid, one["category"], one["question"], said, other])
            continue
        f, r = faith.get(qid), place.get(qid)
        notes = [f"RAG refused at {a['refusal_stage']}"] if a and a["refused"] else []
        notes += [f"{name} wrong: " + "; ".join(x["incorrect"])[:120] for name, x in (("RAG", a), ("LLM", b)) if x and x["incorrect"]]
        held = f"{_percent(f['faithfulness'])} ({f['n_claims']})" if f and f["faithfulness"] is not None else "-"
        seen = {True: "yes", False: "**no**"}.get(r["evidence_found"] if r else None, "-")
        answered.append([qid, one["category"], one["audience"], (r and r["gold_rank"]) or "**miss**", seen, a["verdict"] if a else "n/a", held, b["verdict"] if b else "n/a", " · ".join(notes)])
    out += ["## Questions that should be refused", "", *_table(["id", "cat", "question", "RAG", "LLM-only"], refused)]
    out += ["## Retrieval (answerable questions)", "", f"- Gold document ranked first: {share(found['hit1'], n)}", f"- Gold document in the first five: {share(found['hit5'], n)} · MRR {found['mrr']:.2f}", f"- The answer's text in one of the first five: {share(found['evidence_hits'], found['evidence_n'])}", ""]
    out += _table(["stage", "p50", "p95"], [[s, f"{v['p50']:.2f}s", f"{v['p95']:.2f}s"] for s, v in sorted(latency.items())])
    out += ["## Per question", "", *_table(["id", "cat", "aud", "gold rank", "evidence", "RAG", "RAG faithful", "LLM", "notes"], answered)]
    return "\n".join(out)


def claims_page(answers: DataFrame, limit: int = 1000) -> str:
    """An HTML page of at most `limit` answers: their claims by support, what these cite, and the sources.

    answers: (qid, question, answer, claims: array<struct<claim, verdict, note, cited, supported_by>>, sources:
    array<struct<n, title, section, score, doc_id>>, gold: array of doc_id). Texts are escaped in Spark; a claim whose
    citations share nothing with what supports it is a mismatch, and gold sources are ticked.
    """
    text = lambda c: escape_html(F.coalesce(c.cast("string"), F.lit("")))
    kind = lambda v: F.when(v == "supported", "ok").when(v == "partial", "part").otherwise("bad")
    listed = lambda a, none: F.when(F.size(F.coalesce(a, F.array().cast("array<int>"))) > 0, F.array_join(a, ", ")).otherwise(none)
    claim = lambda c: F.concat(
        F.lit("<li class='"), kind(c["verdict"]), F.lit("'>"), text(c["claim"]), F.lit(" <i>"), text(c["verdict"]), F.when(F.coalesce(c["note"], F.lit("")) != "", F.concat(F.lit(" ("), text(c["note"]), F.lit(")"))).otherwise(""),
        F.lit(" · cited "), listed(c["cited"], "-"), F.lit(" · supported by "), listed(c["supported_by"], "nothing"),
        F.when((F.size(c["cited"]) > 0) & ~F.coalesce(F.arrays_overlap(c["cited"], c["supported_by"]), F.lit(False)), " · citation mismatch").otherwise(""), F.lit("</i></li>"),
    )
    source = lambda s: F.concat(F.lit("<li>["), s["n"].cast("string"), F.lit("] "), F.format_string("%.2f", s["score"].cast("double")), F.lit(" "), text(s["title"]), F.lit(" "), text(s["section"]), F.when(F.array_contains("gold", s["doc_id"]), " ✓").otherwise(""), F.lit("</li>"))
    cards = answers.orderBy("qid").select(
        F.concat(F.lit("<section><h3>"), text(F.col("qid")), F.lit("</h3><p>"), text(F.col("question")), F.lit("</p><blockquote>"), text(F.col("answer")), F.lit("</blockquote><ul>"),
                 F.array_join(F.transform(F.coalesce("claims", F.array()), claim), ""), F.lit("</ul><ol>"), F.array_join(F.transform(F.coalesce("sources", F.array()), source), ""), F.lit("</ol></section>")).alias("card")
    )
    return "<!doctype html><meta charset='utf-8'><title>Claims</title>\n" + "\n".join(r["card"] for r in _within(cards, limit)) + "\n"
