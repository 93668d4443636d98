"""Corpus pipeline: from raw documents to encoded training texts.

STAGES are functions of (spark, docs, sf_dir).  Each returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairline.llm import bpe, decontaminate, exact_dedup, simhash, toxic_crf
from fairline.llm.catalog import tokenizer_file
from fairline.llm.common import table
from fairline.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches a half go."""
    return toxic_crf.drop_toxic(docs, toxic_crf.train(docs, table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: linked at an exact five-word similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.digests(bpe.encode_documents(docs, tokenizer_file()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("SimHash near-dedup", drop_near),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

#: the models and fingerprints of the stages are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
