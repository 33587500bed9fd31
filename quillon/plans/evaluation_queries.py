"""Answer flow, evaluation and usage limits over tables derived from labels, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import answering as A
from quillon.operators import evaluation as E
from quillon.operators import limits as L
from quillon.operators import retrieval as R
from quillon.plans.registry import query, table
from quillon.plans.retrieval_queries import BM25, VEC, chunks, questions, vector_questions, vectors
from quillon.session import durable, small


def _vector_hits(spark, d, k=5):
    return R.vector_topk(vector_questions(spark, d), vectors(spark, d), k)


@query(
    f"""WITH {VEC}, h AS (SELECT qid, chunk_id, score - 0.6 * (qid // 50 % 2) AS score FROM vt WHERE rank BETWEEN 2 AND 5 AND score > 0.35), q AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 50 = 0)
SELECT q.qid, round(coalesce(max(score), 0), 6) AS top_score, coalesce(max(score), 0) >= 0.35 AS passes FROM q LEFT JOIN h USING (qid) GROUP BY 1"""
)
def score_gate(spark, d):
    hits = _vector_hits(spark, d).where("rank >= 2 and score > 0.35").withColumn("score", F.col("score") - 0.6 * (F.floor(F.col("qid") / 50) % 2))
    return A.score_gate(vector_questions(spark, d), hits).withColumn("top_score", F.round("top_score", 6))


_HITS = """h AS (SELECT qid, rank, chunk_id, source AS title, 1990 + doc_id % 30 AS year, doc_id % 4 AS page, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Part ' || doc_id % 3 END AS section, left(text, 50) AS text, score FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 5)"""


def _hits(spark, d, letters=None):
    """The five best documents of each benchmark item, with their whole texts or so many first letters; kept, since several steps read them."""
    text = F.col("text") if letters is None else F.substring("text", 1, letters)
    found = small(R.bm25_topk(questions(spark, d), chunks(spark, d)))
    rows = table(spark, d, "documents").join(found, F.col("doc_id") == F.col("chunk_id"))
    section = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Part "), (F.col("doc_id") % 3).cast("string")))
    return durable(
        rows.select("qid", "rank", "chunk_id", F.col("source").alias("title"), (1990 + F.col("doc_id") % 30).alias("year"), (F.col("doc_id") % 4).alias("page"), section.alias("section"), text.alias("text"), "score")
    )


@query(
    BM25
    + f""", {_HITS} SELECT qid, string_agg('[' || rank || '] ' || title || ' (' || year || ')' || CASE WHEN page <> 0 THEN ', p.' || page ELSE '' END || CASE WHEN section <> '' THEN ', ' || section ELSE '' END || E'\\n' || text, E'\\n\\n' ORDER BY rank) AS context FROM h GROUP BY 1"""
)
def format_context(spark, d):
    return A.format_context(_hits(spark, d, 50))


@query(
    """SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'refuse:score_gate' WHEN turn % 3 = 0 THEN 'refuse:evidence_check' ELSE 'generate' END AS route,
CASE WHEN conv_id % 4 = 0 THEN 'best similarity ' || printf('%.2f', (conv_id % 30) / 100.0) || ' is below 0.35' WHEN turn % 3 = 0 THEN 'the passages do not answer the question' ELSE '' END AS reason FROM conversations"""
)
def route(spark, d):
    way = A.route(F.col("conv_id") % 4 != 0, F.when(F.col("turn") % 3 != 0, F.lit(True)))
    reason = A.refusal_reason(F.regexp_replace(way, "^refuse:", ""), (F.col("conv_id") % 30) / 100.0)
    return table(spark, d, "conversations").select("conv_id", "turn", way.alias("route"), reason.alias("reason"))


@query(f"SELECT conv_id * 1000 + turn AS qid, '{A.REFUSAL}' AS answer, 0 AS sources FROM conversations WHERE conv_id % 4 = 0")
def refusal_rows(spark, d):
    asked = table(spark, d, "conversations").where("conv_id % 4 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"))
    return A.refusal_rows(asked).select("qid", "answer", F.size("sources").alias("sources"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN CASE WHEN turn % 2 = 0 AND turn % 3 <> 0 THEN 'own: ' || left(text, 30) ELSE '{A.REFUSAL}' END ELSE left(text, 50) END AS shown FROM conversations"""
)
def fallback_answers(spark, d):
    """Refused turns show the provider's own answer where that is asked for and there is one."""
    turns = table(spark, d, "conversations")
    own = turns.where("turn % 3 <> 0").select("conv_id", "turn", F.concat(F.lit("own: "), F.substring("text", 1, 30)).alias("fallback"))
    rows = turns.select("conv_id", "turn", (F.col("conv_id") % 4 == 0).alias("refused"), F.substring("text", 1, 50).alias("answer")).join(own, ["conv_id", "turn"], "left")
    answer = F.when(F.col("refused"), F.lit(A.REFUSAL)).otherwise(F.col("answer"))
    return rows.select("conv_id", "turn", A.shown_answer(F.col("refused"), answer, F.col("fallback"), F.col("turn") % 2 == 0).alias("shown"))


_ANSWER = "'x [' || (doc_id % 7) || '] and [3][' || (doc_id % 5) || '] or [99999999999] [0]'"


def _answer(doc_id):
    return F.concat(F.lit("x ["), (doc_id % 7).cast("string"), F.lit("] and [3]["), (doc_id % 5).cast("string"), F.lit("] or [99999999999] [0]"))


@query(
    rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({_ANSWER}, '\[(\d+)\]', 1), lambda x: try_cast(x AS INT)), lambda n: n BETWEEN 1 AND 5))), ',') AS cited FROM documents"""
)
def extract_citations(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.citations(_answer(F.col("doc_id")), F.lit(5)), ",").alias("cited"))


@query(
    BM25
    + f""", {_HITS} SELECT qid, rank::INT AS n, chunk_id, title, nullif(page, 0) AS page, nullif(section, '') AS section, round(score, 3) AS score FROM h WHERE rank IN (1 + qid % 5, 1 + qid % 2)"""
)
def cited_sources(spark, d):
    hits = _hits(spark, d, 50)
    answers = hits.select("qid").distinct().withColumn("answer", F.concat(F.lit("["), (1 + F.col("qid") % 5).cast("string"), F.lit("] ["), (1 + F.col("qid") % 2).cast("string"), F.lit("] [9]")))
    return A.cited_sources(answers, hits)


def stub_grader():
    return lambda question, context: (len(context) % 2 == 0, "even" if len(context) % 2 == 0 else "odd")


def stub_writer():
    return lambda question, context: f"{question[:20]} [1][2]"


@query()
def answer_questions(spark, d):
    asked = questions(spark, d).select("qid", F.col("text").alias("question"))
    hits = _hits(spark, d).withColumn("score", F.col("score") / 40.0)
    return A.answer_questions(asked, hits, stub_grader, stub_writer)


# Graded answers of two sides, made from labels.
_GRADED = """(SELECT doc_id AS qid, side, CASE WHEN doc_id % 6 = 0 THEN 'refuse' ELSE 'answer' END AS expected, CASE WHEN (quality + s) % 2 = 1 THEN 'correct' WHEN toxic = 1 THEN 'partial' ELSE 'incorrect' END AS verdict,
CASE WHEN doc_id % 7 <> 0 THEN ((doc_id + s) % 5) / 4.0::DOUBLE END AS coverage, (doc_id + s) % 3 AS n_incorrect, doc_id % 11 = 0 AS declined, doc_id % 13 = 0 AS refused, substr('ABCDEFGH', (doc_id % 8 + 1)::INT, 1) AS category, CASE doc_id % 3 WHEN 0 THEN 'curious' WHEN 1 THEN 'popular' ELSE 'expert' END AS audience
FROM labels, (VALUES ('rag', 0), ('llm', 1)) AS sides(side, s))"""


def graded(spark, d):
    rows = table(spark, d, "labels").withColumn("x", F.explode(F.array(F.struct(F.lit("rag").alias("side"), F.lit(0).alias("s")), F.struct(F.lit("llm").alias("side"), F.lit(1).alias("s")))))
    i, s = F.col("doc_id"), F.col("x.s")
    return rows.select(
        i.alias("qid"), "x.side", F.when(i % 6 == 0, "refuse").otherwise("answer").alias("expected"), F.when((F.col("quality") + s) % 2 == 1, "correct").when(F.col("toxic") == 1, "partial").otherwise("incorrect").alias("verdict"),
        F.when(i % 7 != 0, ((i + s) % 5) / 4.0).alias("coverage"), ((i + s) % 3).alias("n_incorrect"), (i % 11 == 0).alias("declined"), (i % 13 == 0).alias("refused"),
        F.substring(F.lit("ABCDEFGH"), (i % 8 + 1).cast("int"), F.lit(1)).alias("category"), F.when(i % 3 == 0, "curious").when(i % 3 == 1, "popular").otherwise("expert").alias("audience"),
    )


@query(
    f"""SELECT side, count_if(expected = 'answer' AND verdict = 'correct')::BIGINT AS correct, count_if(expected = 'answer' AND verdict = 'partial')::BIGINT AS partial, round(avg(coalesce(coverage, 0)) FILTER (expected = 'answer'), 6) AS coverage,
count_if(expected = 'answer' AND n_incorrect > 0)::BIGINT AS hallucinated, count_if(expected = 'answer' AND CASE WHEN side = 'rag' THEN refused ELSE declined END)::BIGINT AS false_refusals,
count_if(expected = 'refuse' AND CASE WHEN side = 'rag' THEN refused ELSE declined END)::BIGINT AS correct_refusals FROM {_GRADED} GROUP BY 1"""
)
def eval_summary(spark, d):
    return E.eval_summary(graded(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query(
    f"""WITH g AS (SELECT * FROM {_GRADED} WHERE expected = 'answer'), u AS (SELECT 'category' AS field, category AS key, * FROM g UNION ALL SELECT 'audience', audience, * FROM g)
SELECT field, key, side, count(*) AS n, count_if(verdict = 'correct')::BIGINT AS correct, count_if(verdict = 'partial')::BIGINT AS partial, round(avg(coalesce(coverage, 0)), 6) AS coverage, count_if(n_incorrect > 0)::BIGINT AS wrong FROM u GROUP BY ALL"""
)
def breakdown(spark, d):
    return E.breakdown(graded(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query(f"SELECT qid, CASE WHEN category = 'H' THEN 'offtopic' WHEN expected = 'answer' THEN 'answer' ELSE 'refuse' END AS grp FROM {_GRADED} WHERE side = 'rag'")
def question_group(spark, d):
    return graded(spark, d).where("side = 'rag'").select("qid", E.question_group(F.col("category"), F.col("expected")).alias("grp"))


@query(f"SELECT qid, side, CASE WHEN expected = 'refuse' THEN CASE WHEN declined THEN 'declined' ELSE 'answered_from_memory' END ELSE verdict END AS verdict FROM {_GRADED}")
def refuse_override(spark, d):
    return graded(spark, d).select("qid", "side", E.refuse_override(F.col("expected"), F.col("declined"), F.col("verdict")).alias("verdict"))


@query(f"SELECT qid, side, n_incorrect FROM {_GRADED} WHERE n_incorrect > 0")
def wrong_answers(spark, d):
    return graded(spark, d).where("n_incorrect > 0").select("qid", "side", "n_incorrect")


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN least(least(doc_id % 3, doc_id % 5), 2) / (doc_id % 5)::DOUBLE END AS coverage FROM labels")
def fact_coverage(spark, d):
    flags = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long")), lambda i: i <= F.least(F.col("doc_id") % 3, F.lit(2)))
    return table(spark, d, "labels").select("doc_id", E.coverage(flags, (F.col("doc_id") % 5).cast("int")).alias("coverage"))


_CLAIMS = """(SELECT conv_id AS qid, CASE (conv_id + turn) % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'partial' ELSE 'unsupported' END AS verdict, turn % 2 = 0 AS is_cited, turn % 4 AS c, turn % 3 AS s FROM conversations)"""


def claims(spark, d):
    v = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "supported").when((F.col("conv_id") + F.col("turn")) % 3 == 1, "partial").otherwise("unsupported")
    cited = F.when(F.col("turn") % 2 == 0, F.array((F.col("turn") % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    claim = F.struct(v.alias("verdict"), cited.alias("cited"), F.array((F.col("turn") % 3).cast("int")).alias("supported_by"))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.collect_list(claim).alias("claims"))


@query(
    f"""SELECT qid, count(*)::INT AS n_claims, round(count_if(verdict = 'supported') / count(*), 6) AS faithfulness, round(count_if(verdict <> 'unsupported') / count(*), 6) AS faithfulness_lenient,
round(count_if(is_cited AND verdict <> 'unsupported' AND c = s) / nullif(count_if(is_cited), 0), 6) AS citation_accuracy, (count(*) - count_if(is_cited))::INT AS uncited_claims FROM {_CLAIMS} GROUP BY 1"""
)
def faithfulness(spark, d):
    shares = ("faithfulness", "faithfulness_lenient", "citation_accuracy")
    return E.faithfulness(claims(spark, d)).withColumns({c: F.round(c, 6) for c in shares})


@query(
    """WITH s AS (SELECT event_type AS stage, value AS seconds, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT stage, count(*) AS n, round(median(seconds), 6) AS p50, max(seconds) FILTER (i = greatest(1, round_even(0.95::DOUBLE * n, 0))) AS p95 FROM s GROUP BY 1"""
)
def latency_percentiles(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return E.latency_percentiles(rows).withColumn("p50", F.round("p50", 6))


@query(
    """WITH s AS (SELECT event_id, (value / 600)::DOUBLE AS top_score, event_id % 4 = 0 AS refuse FROM events), t AS (SELECT unnest(range(0, 81)) AS i)
SELECT i / 100.0::DOUBLE AS threshold, round(100.0 * count_if(refuse AND top_score < i / 100.0::DOUBLE) / count_if(refuse), 6) AS caught, round(100.0 * count_if(NOT refuse AND top_score < i / 100.0::DOUBLE) / count_if(NOT refuse), 6) AS wrongly_refused FROM s, t GROUP BY ALL"""
)
def threshold_sweep(spark, d):
    rows = table(spark, d, "events").select((F.col("value") / 600).alias("top_score"), (F.col("event_id") % 4 == 0).alias("should_refuse"))
    return E.threshold_sweep(rows).withColumns({c: F.round(c, 6) for c in ("caught", "wrongly_refused")})


@query(
    """WITH l AS (SELECT source, lang, count(*) AS den, count_if(doc_id % 3 = 0) AS num FROM documents GROUP BY ALL)
SELECT source, lang, num || '/' || den || ' (' || round_even(100.0::DOUBLE * num / den, 0)::BIGINT || '%)' AS label FROM l"""
)
def pct_label(spark, d):
    rows = table(spark, d, "documents").groupBy("source", "lang").agg(F.count_if(F.col("doc_id") % 3 == 0).alias("num"), F.count("*").alias("den"))
    return rows.select("source", "lang", T.share_label(F.col("num"), F.col("den")).alias("label"))


@query(
    """WITH a AS (SELECT doc_id AS qid, toxic AS n FROM labels), j AS (SELECT doc_id AS qid, doc_id % 2 AS unsupported, toxic AS partial FROM labels WHERE quality = 1)
SELECT qid, n > 0 AS human, coalesce(unsupported, 0) + coalesce(partial, 0) > 0 AS judge, (n > 0) = (coalesce(unsupported, 0) + coalesce(partial, 0) > 0) AS agree FROM a LEFT JOIN j USING (qid)"""
)
def judge_agreement(spark, d):
    labels = table(spark, d, "labels")
    audit = labels.select(F.col("doc_id").alias("qid"), F.col("toxic").alias("n_unsupported"))
    judged = labels.where("quality = 1").select(F.col("doc_id").alias("qid"), (F.col("doc_id") % 2).alias("unsupported"), F.col("toxic").alias("partial"))
    return E.judge_agreement(audit, judged)


@query("SELECT item_id, substr(sha256('chat|judge|' || text || '|' || item_id), 1, 16) AS key FROM benchmark")
def baseline_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", E.baseline_key(F.lit("chat"), F.lit("judge"), F.col("text"), F.col("item_id")).alias("key"))


@query("SELECT item_id FROM benchmark WHERE length(text) <= 200")
def cache_misses(spark, d):
    wanted = baseline_key(spark, d)
    cached = wanted.join(table(spark, d, "benchmark").where(F.length("text") > 200).select("item_id"), "item_id")
    return E.cache_misses(wanted, cached).select("item_id")


@query(
    """WITH c AS (SELECT event_id, user_id % 10 AS key, floor(epoch(ts))::BIGINT // 60 AS second, length(props)::BIGINT AS tokens FROM events)
SELECT event_id, sum(tokens) OVER (PARTITION BY key ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)::BIGINT AS window_tokens FROM c"""
)
def rolling_budget(spark, d):
    second = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("key"), second.alias("second"), F.length("props").cast("long").alias("tokens"))
    return E.rolling_tokens(rows).select("event_id", "window_tokens")


@query("SELECT event_type AS model, count(*) AS calls, sum(length(props))::BIGINT AS tokens_in, sum(user_id)::BIGINT AS tokens_out FROM events GROUP BY 1")
def token_usage(spark, d):
    return E.token_usage(table(spark, d, "events").select(F.col("event_type").alias("model"), F.length("props").alias("tokens_in"), F.col("user_id").alias("tokens_out")))


@query(
    """WITH r AS (SELECT event_id, user_id, ts::DATE AS day, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 10 AS s FROM events), q AS (SELECT *, row_number() OVER (PARTITION BY day, s ORDER BY ts, event_id) > 150 AS x FROM r)
SELECT event_id, CASE WHEN s THEN 'session_cap' WHEN x THEN 'day_cap' ELSE 'accept' END AS outcome FROM q"""
)
def usage_caps(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session"), F.to_date("ts").alias("day"), "ts")
    return L.usage_caps(rows).select(F.col("request_id").alias("event_id"), "outcome")


SESSIONS, DAYS = 60, 150


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, ts, dense_rank() OVER (ORDER BY ts::DATE) AS dn, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS r FROM events),
u AS (SELECT DISTINCT user_id, 1::BIGINT AS dn, 0::BIGINT AS before FROM e UNION ALL
SELECT user_id, dn + 1, before + taken FROM (SELECT user_id, dn, before, count(*) FILTER (x <= {DAYS} AND event_id IS NOT NULL) AS taken FROM
(SELECT u.user_id, u.dn, u.before, e.event_id, row_number() OVER (ORDER BY e.event_id IS NULL, e.ts, e.event_id) AS x FROM u LEFT JOIN e ON e.user_id = u.user_id AND e.dn = u.dn AND e.r <= {SESSIONS} - u.before)
GROUP BY ALL) WHERE dn <= (SELECT max(dn) FROM e)),
a AS (SELECT u.user_id, u.dn, u.before, n.before - u.before AS taken FROM u JOIN u n ON n.user_id = u.user_id AND n.dn = u.dn + 1)
SELECT event_id, CASE WHEN r <= taken THEN 'accept' WHEN before + taken >= {SESSIONS} THEN 'session_cap' ELSE 'day_cap' END AS outcome FROM e JOIN a USING (user_id, dn)"""
)
def admissions(spark, d):
    """Sessions that last for days, so that a day's cap leaves them more for the next one."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session"), F.to_date("ts").alias("day"), "ts")
    return L.admissions(rows, SESSIONS, DAYS).select(F.col("request_id").alias("event_id"), "outcome")


@query("SELECT user_id, greatest(0, 10 - count(*)) AS remaining FROM events GROUP BY 1")
def usage_remaining(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(L.remaining(10, F.count("*")).alias("remaining"))


@query(
    """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events), p AS (SELECT max(value) AS p95 FROM s WHERE i = greatest(1, round_even(0.95::DOUBLE * n, 0))), f AS (SELECT avg(toxic) AS f FROM labels)
SELECT f >= 0.9 AS faithfulness_met, p95 <= 8.0 AS latency_met FROM p, f"""
)
def target_check(spark, d):
    p95 = E.latency_percentiles(table(spark, d, "events").select(F.lit("total").alias("stage"), F.col("value").alias("seconds")))
    share = table(spark, d, "labels").agg(F.avg("toxic").alias("f"))
    return share.join(F.broadcast(p95)).select(*E.target_check(F.col("f"), F.col("p95")))
