"""A corpus pipeline: language ID, exact and near deduplication, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents. An empty table passes through every stage; what each does with nulls, empty
texts and repeated rows is said in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import exact, langid, mixing, packing, simhash
from quillon.llm.common import checkpointed, read_texts, small, stored
from quillon.session import removed

SURE = 0.5


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone (id); a broadcast join where gone is measured to be small."""
    return _rows(docs).join(small(checkpointed(gone)), F.col("_k").eqNullSafe(F.col("id")), "left_anti").select("_row.*")


def _rows(docs: DataFrame) -> DataFrame:
    """(_k, _row): the doc_id and the whole row, so that no column of docs clashes with another table's."""
    return docs.select(F.col("doc_id").cast("long").alias("_k"), F.struct("*").alias("_row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts whose language the model knows and holds likelier than not.

    It learns from the labelled documents outside the held-out fold. Texts that are null or without a letter go; if no
    document has a language, all go.
    """
    model = langid.train(docs.select("doc_id", "text", "lang").where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model, keep_rows=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, white space aside: the longest, then the smallest doc_id.

    Rows that repeat an id are told apart by their texts; of rows that repeat id and text one stays.
    """
    found = checkpointed(exact.exact_duplicates(docs))
    ids = checkpointed(found.groupBy(F.col("doc_id").alias("id")).agg(F.count_if("kept").alias("stay"), F.count("*").alias("rows")))
    left = _without(docs, ids.where("stay = 0").select("id"))
    several = checkpointed(ids.where("rows > 1 and stay > 0").select("id"))
    if several.isEmpty():
        return left
    same = F.col("_k").eqNullSafe(F.col("id"))
    kept = found.where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    text = F.coalesce(F.col("_row")["text"], F.lit(""))
    own = _rows(left).join(several, same, "left_semi").withColumn("_sha", F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256))
    own = own.join(kept, same & (F.col("_sha") == F.col("sha")), "left_semi")
    first = Window.partitionBy("_k", "_sha").orderBy(F.length(text).desc())
    own = own.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_row.*")
    return _rows(left).join(several, same, "left_anti").select("_row.*").union(own)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group of near duplicates.

    They are linked at a similarity of 0.8 or more on five-word shingles. Rows with a null doc_id, which no group can
    name, stay.
    """
    found = simhash.similar_documents(docs)
    return _without(docs, found.where("doc_id != component_id").select(F.col("doc_id").alias("id")).distinct())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: sources at their target weights, a row for each pass over a document.

    Documents without words, and those that no drawn block touches, go; sources below their target repeat. Rows are laid
    out by the splitting tree's shards, each shard in its shuffled order.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mix", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned language model, the tokenizer or the keyed draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is stored in the shared folder until the next one is."""
    docs, last = read_texts(spark, sf_dir), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = stored(docs)
            if last:
                removed(spark, last)
            last = path
    return docs
