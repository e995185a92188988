"""The corpus pipeline: from raw documents to token ids, every stage over all rows of the one before."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from repselect.llm import bpe, similar, mixing, quality, secrets
from repselect.llm.queries import TOKENIZER
from repselect.session import settled, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return similar.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs)


#: Weights of the mixture: the quality rules have taken the poor domains away, so only good ones are wanted.
WEIGHTS = {"1,0": 0.98, "1,1": 0.02}


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's token ids and of the text they decode to."""
    return bpe.digests(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("quality rules", rules), ("SimHash near-dedup", near_dedup), ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture), ("BPE encoding and decoding", tokens),
]

#: The fits of the mixing stage are iterative, and SQL has no BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each kept before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs)
    return docs
