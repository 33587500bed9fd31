"""Incremental indexing, sources and corpus analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.operators import analytics as X
from quillon.operators import indexing as I
from quillon.operators import retrieval as R
from quillon.plans.registry import query, table
from quillon.plans.retrieval_queries import VEC, vector_questions, vectors
from quillon.sources import io

_SQL_PRINT = """sha256(text || '{"doc_id":' || doc_id || ',"source":"' || source || '"}600/90/true1')"""


def _prints(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", I.fingerprint(F.col("text"), {"doc_id": F.col("doc_id"), "source": F.col("source")}, "600/90/true").alias("fingerprint"))


@query(f"SELECT doc_id, {_SQL_PRINT} AS fingerprint FROM documents")
def doc_fingerprint(spark, d):
    return _prints(spark, d)


def _state(spark, d):
    """Spanish documents are new, German ones changed, and one source's documents had copies that are gone."""
    docs = table(spark, d, "documents")
    old = _prints(spark, d).join(docs.where("lang <> 'es'").select("doc_id", "lang"), "doc_id")
    old = old.select("doc_id", F.when(F.col("lang") == "de", "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return old.union(docs.where("source = 'src1'").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit("gone").alias("fingerprint")))


@query(f"SELECT doc_id, {_SQL_PRINT} AS fingerprint FROM documents WHERE lang IN ('es', 'de')")
def changed_docs(spark, d):
    return I.changed_docs(_prints(spark, d), _state(spark, d))


@query("SELECT doc_id + 1000000 AS doc_id FROM documents WHERE source = 'src1'")
def removed_docs(spark, d):
    return I.removed_docs(_prints(spark, d), _state(spark, d))


@query(f"SELECT doc_id, {_SQL_PRINT} AS fingerprint FROM documents")
def index_upsert(spark, d):
    now, old = _prints(spark, d), _state(spark, d)
    return I.upserted(old, I.changed_docs(now, old), I.removed_docs(now, old))


# Chunks for statistics: one for each line of a document, sized in words.
_CHUNKS = r"(SELECT doc_id, source AS section, length(t)::BIGINT AS chars, len(string_split(t, ' '))::BIGINT AS tokens FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS source, unnest(string_split(text, E'\n')) AS t FROM documents))"


def sized(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("section"), F.explode(F.split("text", "\n")).alias("t"))
    return docs.select("doc_id", "section", F.length("t").cast("long").alias("chars"), F.size(F.split("t", " ")).cast("long").alias("tokens"))


@query(f"SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(tokens)::BIGINT AS tokens_total, median(tokens) AS tokens_median, max(tokens) AS tokens_max, count(DISTINCT doc_id) FILTER (section = '') AS embedded_this_run FROM {_CHUNKS}")
def ingest_report(spark, d):
    chunks = sized(spark, d).withColumnRenamed("tokens", "n_tokens")
    return I.ingest_report(chunks, chunks.where("section = ''"))


@query(f"SELECT doc_id, count(*) AS chunks FROM {_CHUNKS} GROUP BY 1")
def chunks_by_document(spark, d):
    return I.chunks_by_document(sized(spark, d))


@query(f"SELECT doc_id, sum(chars)::BIGINT AS chars, sum(tokens)::BIGINT AS tokens, round(sum(chars) / sum(tokens), 2) AS chars_per_token FROM {_CHUNKS} GROUP BY 1")
def token_efficiency(spark, d):
    return X.token_efficiency(sized(spark, d))


@query(
    f"""WITH t AS (SELECT doc_id, round(sum(chars) / sum(tokens), 2) AS r FROM {_CHUNKS} GROUP BY 1)
SELECT * FROM (SELECT doc_id, r AS chars_per_token, 'least' AS side, row_number() OVER (ORDER BY r, doc_id) AS place FROM t) WHERE place <= 8
UNION ALL SELECT * FROM (SELECT doc_id, r, 'most', row_number() OVER (ORDER BY r DESC, doc_id) AS place FROM t) WHERE place <= 8"""
)
def bottom_top_n(spark, d):
    return X.bottom_top_n(X.token_efficiency(sized(spark, d)).select("doc_id", "chars_per_token"), "chars_per_token", "doc_id")


@query(f"SELECT count(DISTINCT doc_id) AS docs, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, median(tokens) AS median, min(tokens) AS least, max(tokens) AS largest FROM {_CHUNKS}")
def corpus_stats(spark, d):
    return X.corpus_stats(sized(spark, d))


@query("WITH h AS (SELECT least(27, greatest(0, floor((n_chars / 10.0::DOUBLE - 0) / 700 * 28)))::INT AS bin FROM documents) SELECT b::INT AS bin, count(h.bin) AS n FROM (SELECT unnest(range(0, 28)) AS b) LEFT JOIN h ON h.bin = b GROUP BY 1")
def histogram(spark, d):
    return X.histogram(table(spark, d, "documents").select((F.col("n_chars") / 10.0).alias("v")), "v")


@query(f"SELECT doc_id, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, list_sort(list(tokens))[(count(*) // 2 + 1)::INT] AS upper_median, count(DISTINCT nullif(section, '')) AS sections FROM {_CHUNKS} GROUP BY 1")
def doc_stats(spark, d):
    return X.doc_stats(sized(spark, d))


@query(f"SELECT doc_id, count(*) AS chunks FROM {_CHUNKS} GROUP BY 1")
def chunks_per_doc(spark, d):
    return X.chunks_per_doc(sized(spark, d))


@query("SELECT lang, count(*) AS n FROM documents WHERE contains(lower(source || doc_id), 'c1') GROUP BY 1")
def corpus_filter(spark, d):
    return table(spark, d, "documents").where(X.matches_filter("C1", F.col("source"), F.col("doc_id").cast("string"))).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query(
    f"""WITH {VEC}, xy AS (SELECT vec_id AS chunk_id, e[1] AS x, e[2] AS y FROM v) SELECT qid, round(sum(score * x) / sum(score), 6) AS x, round(sum(score * y) / sum(score), 6) AS y FROM vt JOIN xy USING (chunk_id) WHERE rank <= 5 GROUP BY 1"""
)
def weighted_centroid(spark, d):
    v = vectors(spark, d)
    unit = v.select("chunk_id", N.normalised(F.col("v")).alias("u"))
    found = X.weighted_centroid(R.vector_topk(vector_questions(spark, d), v), unit.select("chunk_id", F.col("u")[0].alias("x"), F.col("u")[1].alias("y")))
    return found.select("qid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p)
SELECT vec_id, round((x - a) / (b - a), 6) AS x, round((y - c) / (d - c), 6) AS y FROM p, m"""
)
def scale01(spark, d):
    points = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return X.scale01(points, ["x", "y"]).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings)
SELECT vec_id, array_to_string(list_transform(e, lambda x: round_even(x / m * 127, 0)::INT), ',') AS codes FROM e"""
)
def quantize_int8(spark, d):
    codes = N.quantized(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(codes.cast("array<string>"), ",").alias("codes"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings)
SELECT vec_id, base64(unhex(array_to_string(list_transform(e, lambda x: printf('%02X', (round_even(x / m * 127, 0)::INT + 256) % 256)), ''))) AS packed FROM e"""
)
def packed_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", X.packed_vector(N.quantized(F.transform("embedding", lambda x: x.cast("double")))).alias("packed"))


@query()
def pca_2d(spark, d):
    rows, shares = X.pca_2d(vectors(spark, d))
    return rows.select(F.col("chunk_id").alias("vec_id"), "x", "y", F.lit(shares[0]).alias("x_share"), F.lit(shares[1]).alias("y_share"))


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 1950 + doc_id % 40 ELSE 2017 END::INT AS first_year, CASE doc_id % 2 WHEN 0 THEN 1960 + doc_id % 40 ELSE 2026 END::INT AS last_year, CASE WHEN doc_id % 3 = 0 THEN 'A, B, C et al.' ELSE 'A, B' END AS authors FROM documents")
def era_timeline(spark, d):
    i = F.col("doc_id")
    years = F.when(i % 2 == 0, F.concat((1950 + i % 40).cast("string"), F.lit("-"), (1960 + i % 40).cast("string"))).otherwise("2017-present")
    authors = F.when(i % 3 == 0, F.array(*map(F.lit, "ABCD"))).otherwise(F.array(*map(F.lit, "AB")))
    return table(spark, d, "documents").select("doc_id", *X.era_bounds(years), X.short_authors(authors).alias("authors"))


@query("SELECT lang, source, min(doc_id) AS first_doc, row_number() OVER (PARTITION BY lang ORDER BY min(doc_id)) AS place FROM documents GROUP BY lang, source")
def corpus_listing(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first_doc"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("first_doc")))


@query("SELECT user_id AS run, event_id AS ord, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS begin FROM events")
def stage_gantt(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return X.stage_gantt(rows).select("run", "ord", F.round("begin", 4).alias("begin"))


@query("SELECT event_id, greatest(0, user_id - length(props) - event_id % 50)::BIGINT AS instructions FROM events")
def token_budget(spark, d):
    return table(spark, d, "events").select("event_id", X.token_budget(F.col("user_id"), F.length("props"), F.col("event_id") % 50).cast("long").alias("instructions"))


@query(
    """WITH e AS (SELECT event_id // 2 AS run_id, CASE WHEN event_id % 10 = 1 THEN 'lost' WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS kind, value AS t FROM events)
SELECT run_id, min(t) FILTER (kind = 'start') AS opened, max(t) FILTER (kind = 'end') AS closed, round(max(t) FILTER (kind = 'end') - min(t) FILTER (kind = 'start'), 6) AS seconds FROM e GROUP BY 1 HAVING min(t) FILTER (kind = 'start') IS NOT NULL"""
)
def paired_calls(spark, d):
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("run_id"), F.when(F.col("event_id") % 10 == 1, "lost").when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"), F.col("value").alias("at"))
    return X.paired_calls(rows).withColumn("seconds", F.round("seconds", 6))


@query("SELECT source AS doc_id, count(DISTINCT doc_id) AS pages, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, round_even(sum(length(text)) / count(DISTINCT doc_id), 0)::BIGINT AS avg_chars, round_even(sum(length(text)) / count(DISTINCT doc_id), 0) < 200 AS scanned FROM documents GROUP BY 1")
def inspect_files(spark, d):
    return io.inspected(table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text"))


@query("SELECT page_id, replace(list_last(string_split(url, '/')), '_', ' ') AS title FROM pages")
def url_titles(spark, d):
    return table(spark, d, "pages").select("page_id", io.url_title(F.col("url")).alias("title"))


@query("SELECT max(printf('2026%02d%02d-1200-run', (doc_id % 12 + 1)::INT, (doc_id % 28 + 1)::INT)) AS run_id FROM documents")
def latest_run(spark, d):
    rows = table(spark, d, "documents").select(F.format_string("2026%02d%02d-1200-run", F.col("doc_id") % 12 + 1, F.col("doc_id") % 28 + 1).alias("run_id"))
    return io.latest_run(rows, "run")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def missing_raw(spark, d):
    docs = table(spark, d, "documents")
    return I.missing_raw(docs, docs.where("doc_id % 10 <> 3"))


@query("SELECT source, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def license_filter(spark, d):
    return table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).groupBy("source").agg(F.count("*").alias("n"))
