"""A training-data pipeline over documents: five stages, each one operator's decision on what came before.

Defined results: a null or empty text has no language and goes in the first stage; rows of one doc_id with unlike texts are
documents of their own, equal rows one document that is kept or dropped with all its rows; rows with a null doc_id are never
duplicates and lose no text; a null source is a source of its own; other columns pass through every stage but the last, whatever
their names (those that begin with _mr_ are the library's own); an empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe_trie, language_id, mixing, near_dedup, registry, suffix_dedup
from millrace.llm.common import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that has 30 % of their words, go."""
    return language_id.accepted(docs, language_id.train(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents, the smallest doc_id stays."""
    return near_dedup.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur earlier are cut from the texts; a document with nothing left goes."""
    return suffix_dedup.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned towards the square root of their size, and shuffled."""
    return mixing.mixed(docs, power=0.5).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each copy's ids, and of the text that they decode to."""
    return bpe_trie.encode_decode_digests(docs, registry.default_tokenizer())


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("mixing", mixed_sources),
    ("bpe", tokens),
]

#: SQL has neither the language model nor the byte-level removal nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written before the next reads it."""
    docs = registry.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else stored(docs, f"stage-{k}"), sf_dir)
    return docs
