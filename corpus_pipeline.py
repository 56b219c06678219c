"""Corpus pipeline: raw documents to a deduplicated, mixed and tokenised corpus.

Every stage takes (spark, docs, sf_dir), works on all documents that the
stage before kept, and returns a DataFrame; ``run`` writes it as Parquet under
the shared checkpoint folder and rereads it as the next stage's documents.

1. quality      drops documents that the quality classifier rejects
2. toxicity     drops documents predicted toxic
3. near_dedup   keeps one document (the least id) of each SimHash component
4. mixing       repeats documents so that expected domain totals meet their targets
5. tokens       byte-level BPE: n_tokens and digests of the ids and of the decoded bytes

Classifiers learn from the labelled rows outside their held-out fold among
the documents they are given.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import byte_bpe, mixing, quality_mil, simhash, toxicity
from larder.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_mil.keep_good(docs, quality_mil.fit(docs, table(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizers = byte_bpe.public_tokenizers()
    return byte_bpe.encode_documents(docs, tokenizers.path("byte_bpe_50k.tiktoken"),
                                     tokenizers.PATTERN, digests=True)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_dedup", near_dedup),
          ("mixing", mix), ("tokens", tokens)]

# Trained classifiers and byte-pair merges: not expressible in SQL; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
