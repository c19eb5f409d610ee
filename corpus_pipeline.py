"""A training-data pipeline over ``documents``: language id, line dedup, near-duplicate removal, decontamination, packing.

Every stage is (name, function of (spark, docs, sf_dir)). ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again as the next one's ``docs``. All stages but the last return the columns of ``documents``; ``n_chars`` is kept up with the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.llm import decontaminate, jaccard, langid, linededup, packing
from lumenry.llm.common import table

#: Documents whose language is less certain than this are rejected, as are those without a letter.
LEAST_CONFIDENCE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents; keeps those that are surely in one of the learned languages."""
    return langid.keep(docs, langid.fit(docs), LEAST_CONFIDENCE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go but for one; documents that lose all lines go."""
    return _sized(linededup.dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word Jaccard similarity 0.8 or more stays."""
    return jaccard.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, with their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language id", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", sequences),
]

#: Learned weights and tokenizer ids can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir))
    return docs
