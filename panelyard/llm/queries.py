"""Registered queries of the subpackage: thin reads of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelyard.llm import (alignment, attention, bpe, chat, fingerprint, langid, mixing, passages,
                           pii, prefix_trie, quality, simhash, token_counts)
from panelyard.llm.sql import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["ORACLE", "QUERIES"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("fp")


@query
def op2_byte_bpe(spark, sf_dir):
    return bpe.encode(documents(spark, sf_dir),
                      outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir))


@query
def op9_quality_rules(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query
def op6_chat_format(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", chat.CONTROL_SAMPLE), (-1, 1, "assistant", chat.CONTROL_SAMPLE)],
                                 "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_conversations(said.unionByName(more)))


@query
def op10_source_mix(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).drop("source", "h")


@query
def op5_private_data(spark, sf_dir):
    return pii.digests(pii.find(documents(spark, sf_dir)))


@query
def op3_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


@query
def op4_prefix_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(documents(spark, sf_dir))


@query
def op7_repeated_passages(spark, sf_dir):
    return passages.repeated_passages(documents(spark, sf_dir))


@query
def op11_tokenizer_alignment(spark, sf_dir):
    return alignment.align(documents(spark, sf_dir))


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op13_quality_attention(spark, sf_dir):
    return attention.quality_scores(documents(spark, sf_dir),
                                    spark.read.parquet(f"{sf_dir}/labels.parquet"))
