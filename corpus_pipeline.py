"""From raw documents to packed sequences: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes what the stage before it kept, as a table written and read again, and its decisions take effect on the rows or texts that it
returns. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.common import documents, free_name, rows_with, written
from matchloom.llm.jaccard import jaccard_classes
from matchloom.llm.mixing import mixed_documents
from matchloom.llm.packing import pack
from matchloom.llm.quality import judge
from matchloom.llm.substring_dedup import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    return judge(docs).filter("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at 0.8 Jaccard or more: that of the least doc_id, where a missing one is least.

    A row is told by the hash of its doc_id and text: only rows that repeat both are one, and texts under one doc_id, or under none, are compared like any others. Of linked texts
    under one doc_id that of the least hash stays."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    key = F.xxhash64(doc_id, F.col("text").isNull(), "text")
    classes = jaccard_classes(docs.select(key.alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = docs.select(key.alias("key"), doc_id.alias("id")).groupBy("key", "id").agg(F.count("*").alias("n"))
    least = classes.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("id", "key", "n")).alias("least"))
    stays = written(least.select("least.key", "least.n"), "stays")
    again = stays.filter("n > 1").select("key")
    kept = rows_with(docs, key, stays.filter("n = 1").select("key"), "once")  # no text is exchanged
    if again.isEmpty():
        return kept
    name = free_name(docs, "n")
    order = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    some = rows_with(docs, key, again, "again").withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(order)))
    return kept.unionByName(some.filter(F.col(name) == 1).drop(name))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and passages that an earlier document or place has."""
    return drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each document and pass, with the words that the mix takes."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the trained scorer nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
