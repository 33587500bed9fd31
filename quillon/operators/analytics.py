"""Corpus statistics and display data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import edge_bin, rounded, upper_median


def token_efficiency(chunks: DataFrame) -> DataFrame:
    """(doc_id, chars, tokens, chars_per_token) of chunks (doc_id, chars, tokens); ratio of sums, two decimals."""
    return chunks.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens")).withColumn("chars_per_token", rounded(F.col("chars") / F.nullif(F.col("tokens"), F.lit(0)), 2))


def bottom_top_n(rows: DataFrame, value: str, key: str, n: int = 8) -> DataFrame:
    """The n rows with the least and the n with the largest value, with side and place; rows can be in both.

    Two top-n plans that keep n rows a task, not a sort of everything.
    """
    low = rows.orderBy(F.col(value), F.col(key)).limit(n).withColumn("side", F.lit("least"))
    high = rows.orderBy(F.col(value).desc(), F.col(key)).limit(n).withColumn("side", F.lit("most"))
    place = Window.partitionBy("side").orderBy(F.when(F.col("side") == "least", F.col(value)).otherwise(-F.col(value)), F.col(key))
    return low.unionByName(high).withColumn("place", F.row_number().over(place))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: docs, chunks, tokens, median, least and largest tokens of a chunk."""
    return chunks.agg(
        F.countDistinct("doc_id").alias("docs"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.percentile("tokens", 0.5).alias("median"), F.min("tokens").alias("least"), F.max("tokens").alias("largest")
    )


def histogram(values: DataFrame, column: str, low: float = 0, high: float = 700, bins: int = 28) -> DataFrame:
    """(bin, n) with every bin; values outside count in the edge bins."""
    counts = values.groupBy(edge_bin(F.col(column), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, tokens, upper_median, sections) per document; sections counts distinct non-empty ones."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), upper_median(F.collect_list("tokens")).alias("upper_median"), F.countDistinct(F.nullif(F.col("section"), F.lit(""))).alias("sections")
    )


def chunks_per_doc(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))


def matches_filter(term: str, *fields: Column) -> Column:
    """Whether the fields, one right after the other, hold the term, in any case."""
    return F.contains(F.lower(F.concat(*fields)), F.lit(term.lower()))


def weighted_centroid(neighbours: DataFrame, coords: DataFrame) -> DataFrame:
    """(qid, x, y): means of the neighbours' (qid, chunk_id, score) coordinates (chunk_id, x, y), weighted by score."""
    rows = neighbours.join(coords, "chunk_id")
    mean = lambda c: (F.sum(F.col("score") * F.col(c)) / F.nullif(F.sum("score"), F.lit(0.0))).alias(c)
    return rows.groupBy("qid").agg(mean("x"), mean("y"))


def scale01(points: DataFrame, columns: list[str]) -> DataFrame:
    """points with each column scaled to 0 … 1 over all rows; null where a column is constant."""
    ends = points.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    rows = points.join(F.broadcast(ends))
    scaled = {c: (F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)) for c in columns}
    return rows.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in points.columns])


def pca_2d(vectors: DataFrame, column: str = "v") -> tuple[DataFrame, list[float]]:
    """vectors with x and y on the first two principal axes, mean-centred, and the shares of variance that they explain."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("_raw", array_to_vector(F.col(column).cast("array<double>")))
    rows = StandardScaler(inputCol="_raw", outputCol="_in", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="_in", outputCol="_out").fit(rows)
    out = model.transform(rows).withColumn("_xy", vector_to_array("_out"))
    return out.withColumns({"x": F.col("_xy")[0], "y": F.col("_xy")[1]}).drop("_raw", "_in", "_out", "_xy"), list(model.explainedVariance)


def packed_vector(codes: Column) -> Column:
    """Base64 of int8 codes, in one line."""
    byte = F.transform(codes, lambda c: F.lpad(F.hex(F.pmod(c, F.lit(256))), 2, "0"))
    return F.replace(F.base64(F.unhex(F.array_join(byte, ""))), F.lit("\r\n"), F.lit(""))  # Spark breaks the line


def era_bounds(years: Column, present: int = 2026) -> list[Column]:
    """first and last year of `a-b`; `present` stands for a fixed year."""
    parts = F.split(years, "-")
    return [parts[0].cast("int").alias("first_year"), F.when(parts[1] == "present", F.lit(present)).otherwise(parts[1].try_cast("int")).alias("last_year")]


def short_authors(authors: Column, n: int = 3) -> Column:
    return F.concat(F.array_join(F.slice(authors, 1, n), ", "), F.when(F.size(authors) > n, " et al.").otherwise(""))


def stage_gantt(stages: DataFrame) -> DataFrame:
    """stages (run, ord, stage, seconds) with the running start of each; absent stages are simply not there."""
    before = Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return stages.withColumn("begin", F.coalesce(F.sum("seconds").over(before), F.lit(0.0)))


def token_budget(total: Column, sources: Column, question: Column) -> Column:
    """Tokens of the instructions: what sources and question leave, at least 0."""
    return F.greatest(F.lit(0), total - sources - question)


def paired_calls(events: DataFrame) -> DataFrame:
    """(run_id, opened, closed, seconds) from start and end events (run_id, kind, at); a call that never ends has nulls."""
    rows = events.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("opened"), F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("closed"))
    return rows.where("opened is not null").withColumn("seconds", F.col("closed") - F.col("opened"))
