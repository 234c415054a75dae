"""A cleaning pipeline over documents: each stage is written as Parquet and read again as the next one's input.

Every stage takes empty tables, texts of any length, and columns of any name; all but the last return their input's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import decontaminate, mixing, simhash, tokens, toxicity
from lodeworks.llm.common import drop_path, staged, table, temporary
from lodeworks.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on labels, calls toxic go; null and empty texts, null ids and repeated rows stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near copies the smallest id stays, with all rows that repeat it; texts without words are one group."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go; those without words stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's share takes them; those without words, which cost nothing, come once."""
    return mixing.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, written as Huffman blocks and read back: one row per document of the mix, null ids first, null texts as empty ones."""
    return tokens.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token files", write_token_files),
]

#: The tokenizer, the fitted grammar and XXH64 fingerprints have no form in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's own tables, and the table it has read, go when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark) as made:
            docs, path = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.remove(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
