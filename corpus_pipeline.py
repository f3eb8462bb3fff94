"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rentlens.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from rentlens.llm.common import saved, table

#: Tokens of a sequence, the id that ends a document, the tokenizer's file.
CAPACITY, END_ID, TOKENIZER = 4096, 1, public_tokenizers.path("word_bpe_49k.json")
#: Words whose ids a worker keeps: few, since workers live through all stages.
KEPT_WORDS = 1 << 17


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go; learnt from the labels of the documents given."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space aside) one stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their shingles of five words one stays."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096: one row per piece, with its place."""
    return packing.packed_documents(docs, TOKENIZER, CAPACITY, END_ID, kept_words=KEPT_WORDS)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("secret_scan", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs


#: SQL states neither the scores nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None
