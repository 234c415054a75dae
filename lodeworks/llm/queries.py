"""The thin registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import chat, codes, decontaminate, licenses, mixing, multiindex, sharding, simhash, substrings, tokens, toxicity, urlfilter, whitening
from lodeworks.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, grammar).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("deviation_exact")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block list is made of the hosts in the table that have an unwanted word in their name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, urlfilter.unwanted_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_source_mixing": op2_source_mixing,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_toxicity": op4_toxicity,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_sharding": op7_sharding,
        "op8_token_files": op8_token_files,
        "op9_license_scan": op9_license_scan,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_url_filters": op12_url_filters,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of what DuckDB can say; the others are held against brute force in the tests."""
    return {
        "op1_embedding_near_dedup": multiindex.ORACLE,
        "op2_source_mixing": mixing.ORACLE,
        "op3_chat_formatting": chat.ORACLE,
        "op5_substring_dedup": substrings.ORACLE,
        "op6_decontamination": decontaminate.ORACLE,
        "op12_url_filters": urlfilter.ORACLE,
        "op13_vector_codes": codes.ORACLE,
    }
