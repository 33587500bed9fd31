"""Gated answering: score gate, evidence check, generation and citations over batches of questions."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.session import durable

MIN_SCORE = 0.35
REFUSAL = "The indexed sources do not hold enough evidence to answer this question."


def score_gate(questions: DataFrame, hits: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """(qid, top_score, passes): the best score, 0.0 without hits."""
    top = hits.groupBy("qid").agg(F.max("score").alias("top_score"))
    joined = questions.select("qid").join(top, "qid", "left").withColumn("top_score", F.coalesce("top_score", F.lit(0.0)))
    return joined.withColumn("passes", F.col("top_score") >= least)


def context_entry(rank: Column, title: Column, year: Column, page: Column, section: Column, text: Column) -> Column:
    """[rank] Title (Year), p.N, section and the text; page 0 and section '' are left out."""
    where = F.concat(
        F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", p."), page.cast("string"))).otherwise(""), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", "), section)).otherwise("")
    )
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), title, F.lit(" ("), year.cast("string"), F.lit(")"), where, F.lit("\n"), text)


def format_context(hits: DataFrame) -> DataFrame:
    """(qid, context) of hits (qid, rank, title, year, page, section, text), by rank, parted by empty lines."""
    entry = context_entry(*[F.col(c) for c in ("rank", "title", "year", "page", "section", "text")])
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), entry.alias("entry")))), lambda e: e["entry"])
    return hits.groupBy("qid").agg(F.array_join(parts, "\n\n").alias("context"))


def route(passes: Column, sufficient: Column) -> Column:
    """refuse:score_gate, refuse:evidence_check or generate."""
    return F.when(~passes, "refuse:score_gate").when(~F.coalesce(sufficient, F.lit(False)), "refuse:evidence_check").otherwise("generate")


def graded(rows: DataFrame, provider: Callable[[], Callable[[str, str], tuple[bool, str]]]) -> DataFrame:
    """rows (qid, question, context) with sufficient and reason from a provider, which is made once a task."""

    def run(batches):
        grade = provider()
        for df in batches:
            found = [grade(q, c) for q, c in zip(df["question"], df["context"], strict=True)]
            yield pd.DataFrame({"qid": df["qid"], "sufficient": [bool(s) for s, _ in found], "reason": [r for _, r in found]})

    return rows.select("qid", "question", "context").mapInPandas(run, "qid long, sufficient boolean, reason string")


def in_workers(rows: DataFrame, workers: int) -> DataFrame:
    """rows in so many partitions: at most so many calls of a provider run at the same time."""
    return rows.repartition(workers)


def baseline(questions: DataFrame, provider: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """(qid, answer): the provider's own answers to (qid, question), without a context."""
    return generated(questions.select("qid", "question", F.lit("").alias("context")), provider)


def timed(stages: dict[str, Callable[[], DataFrame]], spark) -> tuple[dict[str, DataFrame], DataFrame]:
    """Runs the stages one after the other, each to its end: their kept results, and (stage, seconds) rounded to milliseconds."""
    results, seconds = {}, []
    for name, stage in stages.items():
        began = time.monotonic()
        results[name] = durable(stage())
        seconds.append((name, round(time.monotonic() - began, 3)))
    return results, spark.createDataFrame(seconds, "stage string, seconds double")


def generated(rows: DataFrame, provider: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """rows (qid, question, context) with the provider's answer."""

    def run(batches):
        answer = provider()
        for df in batches:
            yield pd.DataFrame({"qid": df["qid"], "answer": [answer(q, c) for q, c in zip(df["question"], df["context"], strict=True)]})

    return rows.select("qid", "question", "context").mapInPandas(run, "qid long, answer string")


def cited_sources(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, n, chunk_id, title, page, section, score) of the hits that answers (qid, answer) cite."""
    sizes = hits.groupBy("qid").agg(F.max("rank").alias("_k"))
    cited = answers.join(sizes, "qid").select("qid", F.explode(T.citations(F.col("answer"), F.col("_k"))).alias("n"))
    rows = cited.join(hits.withColumnRenamed("rank", "n"), ["qid", "n"])
    return rows.select("qid", "n", "chunk_id", "title", F.nullif(F.col("page"), F.lit(0)).alias("page"), F.nullif(F.col("section"), F.lit("")).alias("section"), F.round("score", 3).alias("score"))


def answer_questions(questions: DataFrame, hits: DataFrame, grader, writer, least: float = MIN_SCORE) -> DataFrame:
    """(qid, question, top_score, route, answer, refused, refusal_stage) for every question; providers see gated rows only.

    The gate is applied before the providers run, and each provider's rows are checkpointed, so none is asked twice.
    """
    gate = score_gate(questions, hits, least)
    ready = questions.join(gate.where("passes"), "qid").join(format_context(hits), "qid")
    checks = durable(graded(ready, grader))
    good = ready.join(checks.where("sufficient"), "qid")
    answers = durable(generated(good, writer))
    rows = questions.join(gate, "qid").join(checks, "qid", "left").join(answers, "qid", "left")
    way = route(F.col("passes"), F.col("sufficient"))
    return rows.select(
        "qid", "question", "top_score", way.alias("route"), F.coalesce("answer", F.lit(REFUSAL)).alias("answer"), (way != "generate").alias("refused"),
        F.when(way != "generate", F.regexp_replace(way, "^refuse:", "")).otherwise("").alias("refusal_stage"),
    )


def refusal_reason(stage: Column, top_score: Column, least: float = MIN_SCORE) -> Column:
    gate = F.format_string(f"best similarity %.2f is below {least:.2f}", top_score)
    return F.when(stage == "score_gate", gate).when(stage == "evidence_check", "the passages do not answer the question").otherwise("")


def refusal_rows(questions: DataFrame) -> DataFrame:
    """(qid, answer, sources) of refused questions: the fixed message, no sources."""
    return questions.select("qid", F.lit(REFUSAL).alias("answer"), F.array().cast("array<string>").alias("sources"))


def shown_answer(refused: Column, answer: Column, fallback: Column, use_fallback: Column) -> Column:
    """The answer, or on a refusal the model's own if that is asked for and there is one."""
    return F.when(refused & use_fallback & fallback.isNotNull(), fallback).otherwise(answer)
