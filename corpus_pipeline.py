"""Corpus preparation: the documents pass through the stages in order.

Every stage takes (spark, docs, sf_dir), calls one operator of ``recsim.llm`` and returns a
DataFrame; it is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recsim.llm import packing, pii, simhash, substrings, toxicity
from recsim.llm.common import cut_lineage, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that a classifier, fitted on the labelled ones among them, calls toxic."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return simhash.keep_one_per_group(docs, words=3, max_bits=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the words of every 20-word window that starts earlier too."""
    return substrings.remove_repeats(docs, window=20)


def sanitise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' pieces into sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup),
          ("pii", sanitise_pii), ("best_fit_packing", pack)]

#: A trained classifier, XXH64 and a tokenizer are beyond DuckDB's SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
