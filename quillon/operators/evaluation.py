"""Retrieval, correctness, faithfulness and latency figures of evaluation runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import ratio
from quillon.session import durable

FAITHFULNESS_TARGET, P95_TARGET = 0.90, 8.0


#: An automaton is made for items of at most so many characters; it takes about 100 bytes for each.
AUTOMATON_CHARS = 1 << 20


def _automaton(items: list[tuple[int, str]]):
    """An Aho-Corasick automaton that gives, for each item found, the qids that ask for it."""
    import ahocorasick

    by_text: dict[str, list[int]] = {}
    for qid, item in items:
        by_text.setdefault(item, []).append(qid)
    found = ahocorasick.Automaton()
    for item, qids in by_text.items():
        found.add_word(item, qids)
    found.make_automaton()
    return found


def _held_by(automaton, ids, texts) -> pa.RecordBatch:
    rows = [(q, d) for d, t in zip(ids, texts, strict=True) if t for q in sorted({q for _, qids in automaton.iter(t) for q in qids})]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["qid", "doc_id"])


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, doc_id): the documents (doc_id, text) that hold an item (qid, item) as a run of characters, one row for each pair.

    All items are looked for in one pass over a text, by an automaton. It is sent to all tasks if the items have at most
    AUTOMATON_CHARS characters; beyond, items are dealt to parts of about that size, and each part meets the texts in
    groups of a shuffle. Null or empty items are held by nobody; rows that repeat an item are items of their own.
    """
    asked = items.where("qid is not null and item is not null and item != ''").select(F.col("qid").cast("long").alias("qid"), "item")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = asked.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0]
    if not chars:
        return docs.sparkSession.createDataFrame([], "qid long, doc_id long")
    if chars <= AUTOMATON_CHARS:
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in asked.collect()])  # at most AUTOMATON_CHARS

        def scan(batches):
            automaton = _automaton(shared.value)
            for batch in batches:
                yield _held_by(automaton, batch.column(0).to_pylist(), batch.column(1).to_pylist())

        return texts.mapInArrow(scan, "qid long, doc_id long").distinct()
    parts, cores = -(-chars // AUTOMATON_CHARS), max(1, docs.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = asked.select(F.pmod(F.xxhash64("qid", "item"), F.lit(parts)).cast("int").alias("part"), every(cores).alias("slice"), F.lit(False).alias("right"), F.col("qid").alias("id"), F.col("item").alias("text"))
    met = texts.select(every(parts).alias("part"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(cores)).cast("int").alias("slice"), F.lit(True).alias("right"), F.col("doc_id").alias("id"), "text")

    def groups(batches):
        key, waiting, automaton = None, [], None
        for batch in batches:
            part, piece, right, ids, found = (batch.column(i).to_pylist() for i in range(5))
            at = 0
            while at < len(ids):
                end = at
                while end < len(ids) and (part[end], piece[end], right[end]) == (part[at], piece[at], right[at]):
                    end += 1
                if (part[at], piece[at]) != key:
                    key, waiting, automaton = (part[at], piece[at]), [], None
                if not right[at]:
                    waiting += zip(ids[at:end], found[at:end], strict=True)
                elif waiting or automaton:
                    automaton, waiting = automaton or _automaton(waiting), []
                    yield _held_by(automaton, ids[at:end], found[at:end])
                at = end

    return own.union(met).repartition("part", "slice").sortWithinPartitions("part", "slice", "right").mapInArrow(groups, "qid long, doc_id long").distinct()


def retrieval_metrics(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, gold_rank, hit1, hit5, rr) of the questions of gold (qid, doc_id) over hits (qid, rank, doc_id); misses stay, with rr 0."""
    first = hits.join(gold, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("gold_rank"))
    rows = gold.select("qid").distinct().join(first, "qid", "left")
    rank = F.col("gold_rank")
    return rows.select("qid", "gold_rank", F.coalesce(rank == 1, F.lit(False)).alias("hit1"), F.coalesce(rank <= 5, F.lit(False)).alias("hit5"), F.coalesce(1.0 / rank, F.lit(0.0)).alias("rr"))


def evidence_at_k(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, evidence_found): whether a hit's text matches the question's expression; only questions that have one."""
    found = hits.join(questions.where("evidence is not null").select("qid", "evidence"), "qid").groupBy("qid").agg(F.bool_or(F.rlike("text", F.col("evidence"))).alias("f"))
    return questions.where("evidence is not null").select("qid").join(found, "qid", "left").select("qid", F.coalesce("f", F.lit(False)).alias("evidence_found"))


def question_results(questions: DataFrame, gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, gold_rank, evidence_found) of questions (qid, evidence) with gold (qid, doc_id) over hits (qid, rank, doc_id, text).

    evidence_found is null for a question without an expression.
    """
    right = gold.select("qid", "doc_id", F.lit(True).alias("_right")).distinct()
    joined = hits.join(questions.select("qid", "evidence"), "qid").join(right, ["qid", "doc_id"], "left")
    found = joined.groupBy("qid").agg(F.min(F.when(F.col("_right"), F.col("rank"))).alias("gold_rank"), F.bool_or(F.rlike("text", F.col("evidence"))).alias("f"))
    rows = questions.select("qid", "evidence").join(found, "qid", "left")
    return rows.select("qid", "gold_rank", F.when(F.col("evidence").isNotNull(), F.coalesce("f", F.lit(False))).alias("evidence_found"))


def retrieval_summary(results: DataFrame) -> DataFrame:
    """One row of question_results: n, hit1, hit5, mrr, evidence_hits and its own denominator evidence_n."""
    rank = F.col("gold_rank")
    return results.agg(
        F.count("*").alias("n"), F.count_if(rank == 1).alias("hit1"), F.count_if(rank <= 5).alias("hit5"), F.coalesce(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.count_if("evidence_found").alias("evidence_hits"), F.count("evidence_found").alias("evidence_n"),
    )


def k_curve(first_hits: DataFrame, most: int = 20) -> DataFrame:
    """(method, k, hits, questions) for k = 1 … most of (method, qid, gold_rank), null for a miss."""
    ks = first_hits.select("method", "qid", "gold_rank", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    return ks.groupBy("method", "k").agg(F.count_if(F.col("gold_rank") <= F.col("k")).alias("hits"), F.count("*").alias("questions"))


def first_text_hits(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, gold_rank): the first of the hits (qid, rank, text) whose text matches the expression of its question (qid, evidence).

    Questions without an expression are left out; null where no hit matches.
    """
    asked = questions.where("evidence is not null").select("qid", "evidence")
    found = hits.join(asked, "qid").where(F.rlike("text", F.col("evidence"))).groupBy("qid").agg(F.min("rank").alias("gold_rank"))
    return asked.select("qid").join(found, "qid", "left")


def method_table(first_hits: DataFrame, k: int = 5) -> DataFrame:
    """(method, hit1, hitk, mrr)."""
    rank = F.col("gold_rank")
    return first_hits.groupBy("method").agg(F.count_if(rank == 1).alias("hit1"), F.count_if(rank <= k).alias("hitk"), F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"))


def method_disagreements(first_hits: DataFrame, methods: list[str], k: int = 5) -> DataFrame:
    """(qid, one column of rank a method) of the questions on which the methods differ about a hit within k."""
    hit = F.coalesce(F.col("gold_rank") <= k, F.lit(False))
    differ = first_hits.groupBy("qid").agg(F.min(hit).alias("a"), F.max(hit).alias("b")).where("a <> b").select("qid")
    return first_hits.join(differ, "qid").groupBy("qid").pivot("method", methods).agg(F.first("gold_rank"))


def threshold_sweep(scores: DataFrame, last: int = 80) -> DataFrame:
    """(threshold, caught, wrongly_refused) in percent for thresholds 0.00 … last/100 over (top_score, should_refuse).

    A row counts from the first threshold above its score on, so rows are counted once and summed over the thresholds.
    """
    below = F.floor(F.col("top_score") * 100).cast("int")
    first = F.when(F.col("top_score") < below / 100.0, below).when(F.col("top_score") < (below + 1) / 100.0, below + 1).otherwise(below + 2)
    first = F.least(F.lit(last + 1), F.greatest(F.lit(0), first))
    counts = scores.groupBy(first.alias("i")).agg(F.count_if("should_refuse").alias("r"), F.count_if(~F.col("should_refuse")).alias("a"))
    steps = scores.sparkSession.range(last + 2).select(F.col("id").cast("int").alias("i")).join(F.broadcast(counts), "i", "left")
    sums = Window.partitionBy(F.lit(0)).orderBy("i")  # last + 2 rows
    whole = Window.partitionBy(F.lit(0))
    share = lambda c: (100.0 * ratio(F.coalesce(F.sum(c).over(sums), F.lit(0)), F.sum(c).over(whole)))
    swept = steps.select("i", share("r").alias("caught"), share("a").alias("wrongly_refused"))
    return swept.where(F.col("i") <= last).select((F.col("i") / 100.0).alias("threshold"), "caught", "wrongly_refused")


def question_group(category: Column, expected: Column) -> Column:
    return F.when(category == "H", "offtopic").when(expected == "answer", "answer").otherwise("refuse")


def coverage(flags: Column, facts: Column) -> Column:
    """Share of the facts that the first flags mark as present; missing flags count as absent, null without facts."""
    present = F.size(F.filter(F.slice(F.coalesce(flags, F.array().cast("array<boolean>")), F.lit(1), F.greatest(facts, F.lit(0))), lambda x: x))
    return ratio(present.cast("double"), facts)


def faithfulness(answers: DataFrame) -> DataFrame:
    """Per answer (qid, claims: array<struct<verdict, cited, supported_by>>): claim counts and shares, null without claims."""
    n = F.size("claims")
    cited = F.filter("claims", lambda c: F.size(c["cited"]) > 0)
    good = F.filter(cited, lambda c: (c["verdict"] != "unsupported") & F.arrays_overlap(c["cited"], c["supported_by"]))
    count = lambda test: F.size(F.filter("claims", test)).cast("double")
    return answers.select(
        "qid", n.alias("n_claims"), ratio(count(lambda c: c["verdict"] == "supported"), n).alias("faithfulness"), ratio(count(lambda c: c["verdict"] != "unsupported"), n).alias("faithfulness_lenient"),
        ratio(F.size(good).cast("double"), F.size(cited)).alias("citation_accuracy"), (n - F.size(cited)).alias("uncited_claims"),
    )


def eval_summary(graded: DataFrame) -> DataFrame:
    """(side, correct, partial, coverage, hallucinated, false_refusals, correct_refusals) per side of graded rows.

    graded: (qid, side, expected, verdict, coverage, n_incorrect, declined, refused). The side `rag` counts refusals by its
    own flag, others by the judge's. A null coverage counts as 0.
    """
    answer, refuse = F.col("expected") == "answer", F.col("expected") == "refuse"
    said_no = F.when(F.col("side") == "rag", F.col("refused")).otherwise(F.col("declined"))
    return graded.groupBy("side").agg(
        F.count_if(answer & (F.col("verdict") == "correct")).alias("correct"), F.count_if(answer & (F.col("verdict") == "partial")).alias("partial"),
        F.coalesce(F.avg(F.when(answer, F.coalesce("coverage", F.lit(0.0)))), F.lit(0.0)).alias("coverage"), F.count_if(answer & (F.col("n_incorrect") > 0)).alias("hallucinated"),
        F.count_if(answer & said_no).alias("false_refusals"), F.count_if(refuse & said_no).alias("correct_refusals"),
    )


#: Different values of a stage that may be ranked in one place; ranges that longer stretches are cut into.
PLACE_ROWS, RANGES = 1 << 17, 1024


def latency_percentiles(timings: DataFrame) -> DataFrame:
    """(stage, n, p50, p95) of (stage, seconds): interpolated median, nearest-rank p95, its rank rounded half to even.

    Equal values are counted before they are shuffled. What is asked for is the values at three ranks of a stage; the
    stretch of values that holds a rank is cut into ranges, whose counts say in which one it lies, until the stretch has
    at most PLACE_ROWS different values, which are ranked. So no stage is sorted in one place. Nulls and NaN are left out.
    """
    counts = durable(timings.where("seconds is not null and not isnan(seconds)").groupBy("stage", F.col("seconds").cast("double").alias("seconds")).agg(F.count("*").alias("k")))
    sizes = counts.groupBy("stage").agg(F.sum("k").alias("n"), F.count("*").alias("different"), F.min("seconds").alias("lo"), F.max("seconds").alias("hi"))
    n = F.col("n")
    ranks = F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1, F.greatest(F.lit(1.0), F.rint(0.95 * n)).cast("long"))
    wanted = durable(sizes.select("stage", "n", "lo", "hi", "different", F.lit(0).cast("long").alias("before"), F.posexplode(ranks).alias("which", "place")))
    while not wanted.where(F.col("different") > PLACE_ROWS).isEmpty():
        wanted = durable(_narrowed(counts, wanted))
    inside = counts.join(wanted, "stage").where(F.col("seconds").between(F.col("lo"), F.col("hi")))
    upto = Window.partitionBy("stage", "which").orderBy("seconds")
    reached = inside.withColumn("_upto", F.col("before") + F.sum("k").over(upto)).where(F.col("_upto") >= F.col("place"))
    values = reached.groupBy("stage", "n", "which").agg(F.min("seconds").alias("v"))
    pick = lambda i: F.max(F.when(F.col("which") == i, F.col("v")))
    return values.groupBy("stage").agg(F.first("n").alias("n"), (0.5 * (pick(0) + pick(1))).alias("p50"), pick(2).alias("p95"))


def _narrowed(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with, for each rank whose stretch is long, the range of it that holds the rank."""
    long = wanted.where((F.col("different") > PLACE_ROWS) & (F.col("lo") < F.col("hi")))
    share = (F.col("seconds") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    rows = counts.join(long, "stage").where(F.col("seconds").between(F.col("lo"), F.col("hi")))
    keys = ["stage", "n", "which", "place", "before"]
    parts = rows.groupBy(*keys, F.least(F.lit(RANGES - 1), F.floor(share * RANGES)).alias("part")).agg(F.sum("k").alias("k"), F.count("*").alias("different"), F.min("seconds").alias("lo"), F.max("seconds").alias("hi"))
    upto = Window.partitionBy("stage", "which").orderBy("part")  # at most RANGES rows
    placed = parts.withColumn("_upto", F.col("before") + F.sum("k").over(upto))
    held = placed.where((F.col("_upto") >= F.col("place")) & (F.col("_upto") - F.col("k") < F.col("place")))
    held = held.select("stage", "n", "lo", "hi", "different", (F.col("_upto") - F.col("k")).alias("before"), "which", "place")
    rest = wanted.where((F.col("different") <= PLACE_ROWS) | (F.col("lo") >= F.col("hi"))).select(held.columns)
    return held.union(rest).withColumn("different", F.when(F.col("lo") >= F.col("hi"), F.lit(1)).otherwise(F.col("different")))


def breakdown(graded: DataFrame) -> DataFrame:
    """(field, key, side, n, correct, partial, coverage, wrong) by category and by audience in one pass; answerable only."""
    rows = graded.where(F.col("expected") == "answer").select("side", "verdict", "coverage", "n_incorrect", F.explode(F.array(F.struct(F.lit("category").alias("field"), F.col("category").alias("key")), F.struct(F.lit("audience").alias("field"), F.col("audience").alias("key")))).alias("g"))
    return rows.groupBy("g.field", "g.key", "side").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") == "partial").alias("partial"),
        F.avg(F.coalesce("coverage", F.lit(0.0))).alias("coverage"), F.count_if(F.col("n_incorrect") > 0).alias("wrong"),
    )


def target_check(faithful: Column, p95_seconds: Column) -> list[Column]:
    return [(faithful >= FAITHFULNESS_TARGET).alias("faithfulness_met"), (p95_seconds <= P95_TARGET).alias("latency_met")]


def refuse_override(expected: Column, declined: Column, verdict: Column) -> Column:
    """Verdict of a question that should be refused: declined or answered_from_memory; others keep theirs."""
    return F.when(expected == "refuse", F.when(declined, "declined").otherwise("answered_from_memory")).otherwise(verdict)


def judge_agreement(audit: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, human, judge, agree) of audit (qid, n_unsupported) and judged (qid, unsupported, partial); an unjudged answer has no flags."""
    rows = audit.join(judged, "qid", "left")
    flags = F.coalesce("unsupported", F.lit(0)) + F.coalesce("partial", F.lit(0))
    return rows.select("qid", (F.col("n_unsupported") > 0).alias("human"), (flags > 0).alias("judge"), ((F.col("n_unsupported") > 0) == (flags > 0)).alias("agree"))


def baseline_key(*fields: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the fields joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), 1, 16)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of wanted whose key the cache lacks."""
    return wanted.join(cache.select("key"), "key", "left_anti")


def rolling_tokens(calls: DataFrame, span: int = 60) -> DataFrame:
    """calls (key, second long, tokens) with the tokens of the last `span` seconds, this one included."""
    window = Window.partitionBy("key").orderBy("second").rangeBetween(-(span - 1), 0)
    return calls.withColumn("window_tokens", F.sum("tokens").over(window))


def token_usage(calls: DataFrame) -> DataFrame:
    """(model, calls, tokens_in, tokens_out)."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def rejudge_work(answers: DataFrame, cached: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Saved answers (qid, answer) to grade again: those named in only, if any, and without a grade in cached (qid)."""
    rows = answers.where(F.col("qid").isin(only)) if only else answers
    return rows.join(cached.select("qid"), "qid", "left_anti")


def audited(run_label: str, audit_run: str) -> bool:
    """Whether a manual audit belongs to the run: its label after date and time is part of the run's id."""
    return audit_run.split("-", 2)[-1] in run_label
