"""A corpus from documents: good texts, one of each near copy, no repeated or benchmark passages, packed.

Each stage works on all that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.neardup import keep_one_of_each
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.llm.substring import dedup_substrings
from tessera.session import fresh_path, table, until_exit


def _counted(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each class of near duplicates (five words, similarity 0.8 or more)."""
    return keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has."""
    return _counted(dedup_substrings(docs))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a window of a benchmark item covers."""
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All token ids of the documents, in pieces with a place in a sequence."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmarks", benchmarks), ("packing", packing)]

#: SQL can't express the classifier's fit, MinHash bands, the gear hash or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each but the last written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(until_exit(spark, path))
    return STAGES[-1][1](spark, docs, sf_dir)
