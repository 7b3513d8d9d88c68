"""A training-corpus pipeline over documents: quality, exact and near copies, repeated passages, packing.

A null text counts as empty: it is scored like any text, equals other empty texts, links with nothing and is packed as the closing id alone.
Rows with null or repeated ids are rows of their own in every stage, told apart by a private number; of equal texts the longest original, then the smallest id stays,
and of a class of near copies the smallest id, so ties have one result. An empty table gives no rows in any stage. Columns beside the named ones, whatever their names,
stay with their rows up to the last stage. A very long text costs a task memory in proportion to itself; it is cut in packing only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, exact_dedup, jaccard, packing, quality, substring
from quillspark.llm.common import arrow_settings, own_scratch, scratch_path, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(spark, docs)


def distinct_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8."""
    return jaccard.keep_representatives(spark, docs, 5, 80, 100)


def unrepeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 35-word windows that occur twice; n_chars counts what is left."""
    return substring.keep_unrepeated(spark, docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 4096 tokens."""
    arrow_settings(spark)
    return packing.pack(stored(packing.pieces(docs, bpe.tokenizer_path()), "pack-pieces"))


STAGES = [
    ("quality", good_quality),
    ("exact dedup", distinct_texts),
    ("near dedup", distinct_classes),
    ("substring dedup", unrepeated_passages),
    ("packing", packed),
]

#: The classifier, the tokenizer and the packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        with own_scratch():  # what a stage stored on its way isn't read again
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
