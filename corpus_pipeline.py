"""A training corpus from raw documents: classify, apply rules, drop near-duplicates, mix sources, pack.

Every stage takes a null text as empty (it is scored, fails the rules' least number of words, and so goes), null sources
as one source and null or repeated doc_ids as rows of their own, but for near-duplicates, of which one row stays; an
empty table gives an empty one. All stages but the last return the columns they were given, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docmill.llm import classifier, mixing, packing, rules, simhash
from docmill.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled ones among them, accepts."""
    return classifier.accepted(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base limits and lie near their language's reference."""
    return rules.kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs)


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture wants them."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("temperature_mixing", temperature_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: XXH64 fingerprints and tokenizer ids can't be had in SQL; tests hold the rules' and the near-duplicate stage against
#: brute-force versions on a small table, the others' operators each by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, but for the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
