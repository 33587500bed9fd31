"""Retrieval over documents (as chunks), benchmark items (as questions) and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import evaluation as E
from quillon.operators import retrieval as R
from quillon.plans.registry import query, table, texts
from quillon.session import durable, removed, shared_folder, small
from quillon.sources import providers as P

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def sql_tokens(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.,''\-][a-z0-9]+)*'), lambda x: x NOT IN ({_STOP}))"


BM25 = f"""
WITH c AS MATERIALIZED (SELECT doc_id AS chunk_id, {sql_tokens("text")} AS terms FROM documents),
p AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM c) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM c),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM p, tot GROUP BY term),
w AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS MATERIALIZED (SELECT item_id AS qid, {sql_tokens("text")} AS terms FROM benchmark),
a AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(terms) AS term FROM q) GROUP BY ALL),
s AS (SELECT qid, p.chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(c.terms) / avgdl))) AS score
      FROM a JOIN p USING (term) JOIN w USING (term) JOIN c ON c.chunk_id = p.chunk_id, tot GROUP BY ALL),
allp AS (SELECT q.qid, c.chunk_id, coalesce(s.score, 0) AS score FROM q CROSS JOIN c LEFT JOIN s ON s.qid = q.qid AND s.chunk_id = c.chunk_id),
bm AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM allp) WHERE rank <= 50)
"""

VEC = """
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
vt AS MATERIALIZED (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
       FROM (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, list_dot_product(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 50 = 0)) WHERE rank <= 20)
"""

# The stub embedding: signs of hashed words in 64 places.
STUB = r"""
tw AS (SELECT 'd' AS side, doc_id AS id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents UNION ALL SELECT 'q', item_id, unnest(string_split_regex(lower(text), '\s+')) FROM benchmark),
tb AS MATERIALIZED (SELECT side, id, b, x FROM (SELECT side, id, ('0x' || md5(w)[1:2])::INT % 64 AS b, sum(CASE WHEN md5(w)[3:3] < '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM tw WHERE w <> '' GROUP BY ALL) WHERE x <> 0),
tn AS MATERIALIZED (SELECT side, id, sqrt(sum(x * x)) AS n FROM tb GROUP BY ALL),
dot AS (SELECT q.id AS qid, d.id AS chunk_id, sum(q.x * d.x) AS s FROM tb q JOIN tb d USING (b) WHERE q.side = 'q' AND d.side = 'd' GROUP BY ALL),
st AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM
(SELECT q.id AS qid, d.id AS chunk_id, coalesce(s, 0) / (q.n * d.n) AS score FROM tn q JOIN tn d ON q.side = 'q' AND d.side = 'd' LEFT JOIN dot ON dot.qid = q.id AND dot.chunk_id = d.id)) WHERE rank <= 50)
"""

GOLD = "gold AS MATERIALIZED (SELECT item_id AS qid, list(doc_id ORDER BY doc_id) AS gold FROM benchmark b, documents d WHERE contains(d.text, b.text) GROUP BY 1)"
FIRST = "first AS (SELECT g.qid, min(rank) FILTER (list_contains(gold, chunk_id) AND rank <= 5) AS gold_rank FROM gold g LEFT JOIN bm ON bm.qid = g.qid GROUP BY 1)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")


def vector_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))


def with_texts(hits: DataFrame, held: DataFrame) -> DataFrame:
    """hits (…, chunk_id) with their chunks' texts; few hits are sent to the texts."""
    return held.select("chunk_id", "text").join(small(hits), "chunk_id")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id): the documents that hold the benchmark item, a row for each pair.

    Kept, since it is used more than once.
    """
    docs = texts(spark, d, "documents").select("doc_id", "text")
    return durable(E.holders(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))))


@query(f"SELECT doc_id, pos - 1 AS pos, terms[pos] AS term FROM (SELECT doc_id, terms, generate_subscripts(terms, 1) AS pos FROM (SELECT doc_id, {sql_tokens('text')} AS terms FROM documents))")
def bm25_tokens(spark, d):
    return texts(spark, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term"))


@query(BM25 + "SELECT term, df, round(idf, 6) AS idf, sum(tf)::BIGINT AS total FROM w JOIN p USING (term) GROUP BY ALL")
def bm25_index(spark, d):
    return R.term_weights(durable(R.term_counts(chunks(spark, d)))).select("term", "df", F.round("idf", 6).alias("idf"), "total")


@query(BM25 + "SELECT qid, chunk_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 5")
def bm25_topk(spark, d):
    return R.bm25_topk(questions(spark, d), chunks(spark, d)).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(BM25 + "SELECT qid, chunk_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 5")
def bm25_stored_topk(spark, d):
    path = f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
    R.store_index(chunks(spark, d), path)
    found = durable(R.stored_topk(spark, path, questions(spark, d)))
    removed(spark, path)
    return found.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {VEC} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM vt WHERE rank <= 5")
def vector_topk(spark, d):
    return R.retrieve(vector_questions(spark, d), vectors(spark, d)).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id,
    list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(c.e, c.e)) AS score FROM v q, v c WHERE q.vec_id <> c.vec_id)
    SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 5"""
)
def knn_graph(spark, d):
    return R.knn_graph(vectors(spark, d), 5).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def ann_topk(spark, d):
    """What the graph finds; a test holds its recall against vector_topk."""
    return R.retrieve(vector_questions(spark, d), vectors(spark, d), "ann", 10).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {VEC} SELECT qid, chunk_id, round(score, 6) AS score FROM vt WHERE rank <= 3")
def cosine_matrix_topk(spark, d):
    return R.vector_topk(vector_questions(spark, d), vectors(spark, d), 3).select("qid", "chunk_id", F.round("score", 6).alias("score"))


_LISTS = BM25 + f""", {STUB}, lists AS (SELECT qid, 'vector' AS list, chunk_id, rank FROM st WHERE rank <= 10 UNION ALL SELECT qid, 'bm25', chunk_id, rank FROM bm WHERE rank <= 10)"""


def embedded_topk(spark, d, k):
    """Vector search of the benchmark items among the documents, both embedded by the stub provider."""
    asked = P.embedded(questions(spark, d).select(F.col("qid").alias("id"), "text"), None, P.stub_embedder).select(F.col("id").alias("qid"), "v")
    return R.vector_topk(durable(asked), P.embedded_in_place(chunks(spark, d).select("chunk_id", "text"), P.stub_embedder), k)


def _lists(spark, d):
    hits = embedded_topk(spark, d, 10).select("qid", F.lit("vector").alias("list"), "chunk_id", "rank")
    keyword = R.bm25_topk(questions(spark, d), chunks(spark, d), 10)
    return durable(hits.union(keyword.select("qid", F.lit("bm25").alias("list"), "chunk_id", "rank")))  # also_in reads them twice


@query(
    _LISTS
    + """, f AS (SELECT qid, chunk_id, sum(0.5::DOUBLE / (60 + rank)) AS score, min(CASE WHEN list = 'vector' THEN rank ELSE 1000 + rank END) AS seen FROM lists GROUP BY ALL)
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM f) WHERE rank <= 5"""
)
def rrf_fuse(spark, d):
    return R.rrf(_lists(spark, d), {"vector": 0.5, "bm25": 0.5}).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    _LISTS
    + """, t AS (SELECT *, CASE WHEN list = 'vector' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + rank) AS part FROM lists)
SELECT qid, list, chunk_id, rank, round(part, 5) AS part FROM t"""
)
def rrf_parts(spark, d):
    weight = F.when(F.col("list") == "vector", 0.7).otherwise(0.3)
    return _lists(spark, d).select("qid", "list", "chunk_id", "rank", F.round(weight / (60 + F.col("rank")), 5).alias("part"))


@query(
    _LISTS
    + """, n AS (SELECT qid, chunk_id, list(DISTINCT list) AS names FROM lists GROUP BY ALL)
SELECT qid, l.list, chunk_id, rank, array_to_string(list_sort(list_filter(names, lambda x: x <> l.list)), ',') AS also FROM lists l JOIN n USING (qid, chunk_id)"""
)
def also_in(spark, d):
    return R.other_lists(_lists(spark, d)).select("qid", "list", "chunk_id", "rank", F.array_join("also", ",").alias("also"))


@query(_LISTS + """SELECT qid, rank, min(chunk_id) FILTER (list = 'vector') AS vector, min(chunk_id) FILTER (list = 'bm25') AS bm25 FROM lists GROUP BY ALL""")
def rank_pivot(spark, d):
    return R.rank_pivot(_lists(spark, d), ["vector", "bm25"])


@query(
    BM25
    + f""", {STUB},
l AS (SELECT qid, 'vector' AS list, chunk_id, rank FROM st WHERE rank <= 20 UNION ALL SELECT qid, 'bm25', chunk_id, rank FROM bm WHERE rank <= 20),
f AS (SELECT qid, chunk_id, sum(0.5::DOUBLE / (60 + rank)) AS score, min(CASE WHEN list = 'vector' THEN rank ELSE 1000 + rank END) AS seen FROM l GROUP BY ALL)
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM f) WHERE rank <= 5"""
)
def hybrid_topk(spark, d):
    return R.hybrid_topk(embedded_topk(spark, d, 20), R.bm25_topk(questions(spark, d), chunks(spark, d), 20)).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(BM25 + """SELECT bm.qid, bm.chunk_id, array_to_string(list_sort(list_intersect(q.terms, c.terms)), ' ') AS terms FROM bm JOIN q USING (qid) JOIN c USING (chunk_id) WHERE rank <= 5""")
def matched_terms(spark, d):
    q, c = questions(spark, d), chunks(spark, d)
    return R.matched_terms(q, c, R.bm25_topk(q, c).select("qid", "chunk_id")).select("qid", "chunk_id", F.array_join(F.array_sort("terms"), " ").alias("terms"))


@query(
    BM25
    + """, o AS (SELECT qid, term, min(pos) AS pos FROM (SELECT qid, terms[pos] AS term, pos FROM (SELECT qid, terms, generate_subscripts(terms, 1) AS pos FROM q)) GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS pos, term, coalesce(df, 0) AS df, round(100.0 * coalesce(df, 0) / n, 4) AS share, round(coalesce(idf, 0), 2) AS idf
FROM o LEFT JOIN w USING (term), tot"""
)
def term_stats(spark, d):
    return R.term_stats(questions(spark, d), chunks(spark, d))


@query(
    f"""WITH {VEC}, w AS (SELECT q.vec_id AS qid, (q.vec_id * 13 + 5) % (SELECT count(*) FROM v) AS chunk_id FROM v q WHERE q.vec_id % 50 = 0),
s AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, round(list_dot_product(q.e, c.e), 9) AS score FROM v q, v c WHERE q.vec_id % 50 = 0)
SELECT w.qid, w.chunk_id, (SELECT count(*) FROM s o WHERE o.qid = w.qid AND o.score > m.score) + 1 AS position FROM w JOIN s m ON m.qid = w.qid AND m.chunk_id = w.chunk_id"""
)
def chunk_rank(spark, d):
    q, n = vector_questions(spark, d), vectors(spark, d).count()
    return R.rank_of(q, vectors(spark, d), q.select("qid", ((F.col("qid") * 13 + 5) % n).alias("chunk_id")))


@query(BM25 + "SELECT qid, rank - 1 AS pos, chunk_id, left(text, 40) AS opening FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 5")
def context_texts(spark, d):
    hits = R.bm25_topk(questions(spark, d), chunks(spark, d))
    wanted = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return R.texts_in_order(wanted, chunks(spark, d)).select("qid", "pos", "chunk_id", F.substring("text", 1, 40).alias("opening"))


def _metrics(spark, d):
    g = gold(spark, d)
    hits = R.bm25_topk(questions(spark, d).join(g, "qid", "left_semi"), chunks(spark, d)).select("qid", "rank", F.col("chunk_id").alias("doc_id"))
    return E.retrieval_metrics(g, hits)


@query(BM25 + f", {GOLD}, {FIRST} SELECT qid, gold_rank, coalesce(gold_rank = 1, false) AS hit1, coalesce(gold_rank <= 5, false) AS hit5, round(coalesce(1.0 / gold_rank, 0), 6)::DOUBLE AS rr FROM first")
def retrieval_metrics(spark, d):
    return _metrics(spark, d).withColumn("rr", F.round("rr", 6))


@query(
    BM25
    + f""", {GOLD}, {FIRST}, ev AS (SELECT qid, bool_or(regexp_matches(d.text, '[0-9]')) AS f FROM bm JOIN gold USING (qid) JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = qid WHERE rank <= 5 AND length(b.text) > 200 GROUP BY 1)
SELECT count(*) AS n, count_if(gold_rank = 1)::BIGINT AS hit1, count_if(gold_rank <= 5)::BIGINT AS hit5, round(avg(coalesce(1.0 / gold_rank, 0)), 6) AS mrr, count_if(f)::BIGINT AS evidence_hits, count(f) AS evidence_n
FROM first LEFT JOIN ev USING (qid)"""
)
def retrieval_summary(spark, d):
    g = gold(spark, d)
    asked = questions(spark, d).join(g, "qid", "left_semi").withColumn("evidence", F.when(F.length("text") > 200, F.lit("[0-9]")))
    c = chunks(spark, d)
    hits = with_texts(R.bm25_topk(asked.select("qid", "text"), c).select("qid", "rank", "chunk_id"), c).withColumnRenamed("chunk_id", "doc_id")
    return E.retrieval_summary(E.question_results(asked, g, hits)).withColumn("mrr", F.round("mrr", 6))


@query(
    BM25
    + """SELECT item_id AS qid, bool_or(regexp_matches(d.text, split_part(b.text, ' ', 1), 'l') IS TRUE AND contains(d.text, split_part(b.text, ' ', 1))) AS evidence_found
FROM benchmark b JOIN bm ON bm.qid = b.item_id AND rank <= 5 JOIN documents d ON d.doc_id = bm.chunk_id WHERE regexp_full_match(split_part(b.text, ' ', 1), '[A-Za-z]+') GROUP BY 1"""
)
def evidence_at_k(spark, d):
    word = F.split("text", " ")[0]
    asked = questions(spark, d).withColumn("evidence", F.when(word.rlike("^[A-Za-z]+$"), word)).withColumnRenamed("text", "question")
    c = chunks(spark, d)
    hits = with_texts(R.bm25_topk(questions(spark, d), c).select("qid", "rank", "chunk_id"), c)
    return E.evidence_at_k(asked, hits)


_POOLS = """l AS (SELECT qid, 'vector' AS list, chunk_id, rank FROM st WHERE rank <= 20 UNION ALL SELECT qid, 'bm25', chunk_id, rank FROM bm WHERE rank <= 20),
fu AS (SELECT qid, chunk_id, sum(0.5::DOUBLE / (60 + rank)) AS score, min(CASE WHEN list = 'vector' THEN rank ELSE 1000 + rank END) AS seen FROM l GROUP BY ALL),
lists AS (SELECT * FROM l UNION ALL SELECT qid, 'hybrid', chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM fu)"""
_FIRSTS = BM25 + f""", {STUB}, {GOLD}, {_POOLS}, m AS (SELECT method, g.qid, min(rank) FILTER (list_contains(gold, chunk_id) AND rank <= 20) AS gold_rank FROM gold g CROSS JOIN (VALUES ('bm25'), ('vector'), ('hybrid')) AS n(method) LEFT JOIN lists ON lists.qid = g.qid AND list = method GROUP BY ALL)"""
METHODS = ["bm25", "vector", "hybrid"]


def _pools(spark, d, k):
    """The k best chunks of each item by each method."""
    keyword = durable(R.bm25_topk(questions(spark, d), chunks(spark, d), k).select("qid", "chunk_id", "rank"))
    vector = durable(embedded_topk(spark, d, k).select("qid", "chunk_id", "rank"))
    return {"bm25": keyword, "vector": vector, "hybrid": R.hybrid_topk(vector, keyword, k).select("qid", "chunk_id", "rank")}


def _firsts(spark, d):
    """(method, qid, gold_rank) of three methods over the items that a document holds, null for a miss."""
    g, found = gold(spark, d), None
    for name, hits in _pools(spark, d, 20).items():
        own = E.retrieval_metrics(g, hits.withColumnRenamed("chunk_id", "doc_id")).select(F.lit(name).alias("method"), "qid", "gold_rank")
        found = own if found is None else found.union(own)
    return found


@query(_FIRSTS + "SELECT method, k, count(*) FILTER (gold_rank <= k) AS hits, count(*) AS questions FROM m, (SELECT unnest(range(1, 21)) AS k) GROUP BY ALL")
def k_curve(spark, d):
    return E.k_curve(_firsts(spark, d))


def evidence_of(text):
    """An expression for five words from the middle of a text."""
    words = F.split(text, " ")
    middle = F.array_join(F.slice(words, F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int") - 2), F.lit(5)), " ")
    return F.concat(F.lit("\\Q"), middle, F.lit("\\E"))


@query(
    BM25
    + f""", {STUB}, {_POOLS.replace("rank <= 20", "rank <= 50")}, e AS (SELECT item_id AS qid, array_to_string(w[greatest(1, len(w) // 2 - 2):greatest(1, len(w) // 2 - 2) + 4], ' ') AS evidence FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
h AS (SELECT list AS method, lists.qid, min(rank) AS gold_rank FROM lists JOIN e ON e.qid = lists.qid JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 50 AND contains(d.text, evidence) GROUP BY ALL),
m AS (SELECT method, e.qid, gold_rank FROM e CROSS JOIN (VALUES ('bm25'), ('vector'), ('hybrid')) AS n(method) LEFT JOIN h USING (qid, method))
SELECT method, k, count(*) FILTER (gold_rank <= k) AS hits, count(*) AS questions FROM m, (SELECT unnest(range(1, 21)) AS k) GROUP BY ALL"""
)
def k_curve_text(spark, d):
    """Hits of the evidence itself, in the texts of the first 50 of each method."""
    asked = durable(questions(spark, d).select("qid", evidence_of(F.col("text")).alias("evidence")))
    found = None
    for name, hits in _pools(spark, d, 50).items():
        own = E.first_text_hits(asked, with_texts(hits, chunks(spark, d))).select(F.lit(name).alias("method"), "qid", "gold_rank")
        found = own if found is None else found.union(own)
    return E.k_curve(found)


@query(_FIRSTS + "SELECT method, count(*) FILTER (gold_rank = 1) AS hit1, count(*) FILTER (gold_rank <= 5) AS hitk, round(avg(coalesce(1.0 / gold_rank, 0)), 6) AS mrr FROM m GROUP BY ALL")
def method_table(spark, d):
    return E.method_table(_firsts(spark, d)).withColumn("mrr", F.round("mrr", 6))


@query(
    _FIRSTS
    + """SELECT qid, min(gold_rank) FILTER (method = 'bm25') AS bm25, min(gold_rank) FILTER (method = 'vector') AS vector, min(gold_rank) FILTER (method = 'hybrid') AS hybrid FROM m
GROUP BY 1 HAVING min(coalesce(gold_rank <= 5, false)::INT) <> max(coalesce(gold_rank <= 5, false)::INT)"""
)
def method_disagreements(spark, d):
    return E.method_disagreements(_firsts(spark, d), METHODS)
