"""Training text from raw documents: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from filmfold.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from filmfold.llm.common import table, word_count, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from ``labels`` and from the documents given."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier place repeats; one that loses all its words so goes.

    Such a document is a copy whose every line stands elsewhere. Documents that
    had no word before stay.
    """
    out = line_dedup.without_repeated_lines(docs)
    return out.filter((F.col("lines_dropped") == 0) | (word_count(F.col("text")) > 0)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal word shingles, the one with the smallest doc_id."""
    return ngram_join.one_per_group(docs).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken."""
    return mixing.mix(docs).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digest of the ids for every document of the mix."""
    tokens = bpe.encode(docs, VOCABULARY, keep=["source"])
    return tokens.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Training a classifier and MinHash candidates are beyond SQL; tests/llm checks each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. An empty table, null texts and extra columns pass through every stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
