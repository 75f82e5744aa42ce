"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann_multi_index, bpe_trie, chat_quotes, html_extract, language_id, mixing, near_dedup, oracles, quality_rules, suffix_dedup, token_store

Query = Callable[[SparkSession, str], DataFrame]

#: Tokens end with this id in the token files (fixed value).
END_ID = 2
#: Words of a shingle in op5's contract.
SHINGLE = 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_digest(table(spark, sf_dir, "documents"), default_tokenizer(), END_ID)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "copy", "n_copies", F.round("rate", 9).alias("rate"), "shuffle_key", F.md5("text").alias("text_md5"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.grouped(table(spark, sf_dir, "documents"), SHINGLE)


def op6_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.reply_ordered(table(spark, sf_dir, "conversations")).drop("text")


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_decode_digests(table(spark, sf_dir, "documents"), default_tokenizer())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    away = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~away))
    return language_id.identified(docs.select("doc_id", away.alias("held_out"), "text"), model).drop("text")


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_multi_index.search(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_html_extract, op2_token_store, op3_quality_rules, op4_mixing, op5_near_dedup, op6_chat_quotes, op7_bpe_trie, op8_suffix_dedup, op9_language_id, op10_multi_index)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.SQL, "op4_mixing": mixing.SQL, "op5_near_dedup": oracles.NEAR_DEDUP, "op6_chat_quotes": chat_quotes.SQL, "op8_suffix_dedup": oracles.SUFFIX_DEDUP}
