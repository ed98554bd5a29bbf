"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chat import chat_digests, format_chats
from .common import table
from .decontaminate import find_contamination
from .divergence import audit_sources
from .html_text import extract_main_text
from .language_id import identify, train
from .licenses import license_digests, scan_licenses
from .ngram_join import near_duplicates
from .packing import pack
from .prefix_trie import prefix_trie, share_openings, turn_sequences
from .quality import judge_quality
from .sharding import shard
from .token_counts import count_tokens, read_tokenizer
from .url_filter import LISTED, judge_urls

Query = Callable[[SparkSession, str], DataFrame]

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))
    return judge_urls(table(spark, sf_dir, "pages"), listed)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_tokenizer(PIECE_MODEL))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, train(documents))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return chat_digests(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), read_tokenizer(BYTE_VOCABULARY))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests(scan_licenses(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(share_openings(turn_sequences(table(spark, sf_dir, "conversations"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_sharding": op3_sharding,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_packing": op9_packing,
    "op10_html_extraction": op10_html_extraction,
    "op11_license_scan": op11_license_scan,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": oracles.DECONTAMINATION,
    "op2_url_filter": oracles.URL_FILTER,
    "op3_sharding": oracles.SHARDING,
    "op4_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op7_quality_rules": oracles.QUALITY_RULES,
    "op8_chat_formatting": oracles.CHAT_FORMATTING,
    "op11_license_scan": oracles.LICENSE_SCAN,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_source_divergence": oracles.SOURCE_DIVERGENCE,
}
