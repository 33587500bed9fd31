"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import ann, exact, infill, langid, lm, mixing, negatives, packing, secrets, sharding, simhash, substrings, toxicity
from quillon.llm.common import read_table, read_texts


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_texts(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(read_texts(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(read_texts(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.BASE + secrets.MORE
    found = secrets.scan(read_texts(spark, sf_dir), rules)
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))

    def of_kind(i: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    counts = [of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.joined(base, rules), 256).alias("base_sha256"), secrets.joined(F.col("spans"), rules).alias("spans")
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read_texts(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(read_texts(spark, sf_dir))
    taken = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    drawn = F.transform("segments", lambda s: F.concat_ws(":", s["pass"], s["start"], s["length"], s["shard"], s["sort"]))
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(drawn, ",").alias("drawn"))


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_texts(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read_texts(spark, sf_dir))


def op10_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_texts(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.fill_in_middle(read_texts(spark, sf_dir))
    back = infill.restored(F.col("form"), F.col("output"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256")
    )


def op13_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read_texts(spark, sf_dir))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_simhash_near_dedup,
            op2_language_id,
            op3_toxicity,
            op4_secret_scan,
            op5_nearest_neighbours,
            op6_substring_dedup,
            op7_source_mix,
            op8_shard_documents,
            op9_exact_dedup,
            op10_pack_tokens,
            op11_hard_negatives,
            op12_fill_in_middle,
            op13_language_model_scores,
        )
    }


_WORD = r"[^\x20\x09-\x0D]+"

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM k
"""

OP6 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN (SELECT s, min(doc_id) AS f FROM win GROUP BY s) USING (s) WHERE f < doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM w) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def _any_case(regex: str) -> str:
    """The expression of a (?i) rule with each letter of its first group in both cases; RE2's own folding goes beyond ASCII."""
    if not regex.startswith("(?i)"):
        return regex
    head, tail = regex[4:].split(")", 1)
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail


def _op4_sql() -> str:
    parts = []
    for i, rule in enumerate(secrets.BASE + secrets.MORE):
        regex = _any_case(rule.regex).replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {i} AS k, '{rule.kind}' AS kind, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, length(hits[i]) AS n
FROM (SELECT doc_id, hits, groups, gaps, unnest(generate_series(1, len(hits))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{regex}', 0) AS hits, regexp_extract_all(text, '{regex}', {rule.group}) AS groups, string_split_regex(text, '{regex}') AS gaps FROM documents))
WHERE length(groups[i]) >= {rule.shortest}"""
        )
    label = "kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT"
    base = len(secrets.BASE)
    counts = ", ".join(f"count_if(k = {i})::BIGINT AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""WITH s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg({label}, ',' ORDER BY a, k) FILTER (k < {base}) AS base, string_agg({label}, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


OP11 = """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS own, list_dot_product(a.v, b.v)::BIGINT AS s FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS i FROM s WHERE own) WHERE i <= 5),
n AS (SELECT p.a, p.b AS pos, n.b AS neg, p.s AS ps, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS i FROM p JOIN s n ON n.a = p.a AND NOT n.own AND 100 * n.s BETWEEN 50 * p.s AND 95 * p.s)
SELECT a AS anchor_id, pos AS positive_id, i::INT AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE i <= 3
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(w) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11, "op12_fill_in_middle": OP12, "op4_secret_scan": _op4_sql(), "op6_substring_dedup": OP6, "op9_exact_dedup": OP9}
