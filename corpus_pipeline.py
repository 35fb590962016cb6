"""Corpus preparation from raw documents to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import decontamination, jaccard, kneser_ney, mixing, sharding
from trailmark.llm.common import table, written


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.drop_rejected(docs, table(spark, sf_dir, "labels"), stored=True)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_similar(docs, words=5, enough=(4, 5))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), whole_from=3)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES = [
    ("quality classifier", of_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("sharding", into_shards),
]

# The language model, the rounding draws and the histogram search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of ``documents``; each stage is written as Parquet and read again by the next.

    A null or empty text has no words, so no stage finds anything in it, and it keeps its place in a shard; a null id or source
    is a value like any other, and repeated rows are judged one by one except as copies of each other. Without documents
    there are no rows; other columns of the documents go through all stages but the last.
    """
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
    return docs
