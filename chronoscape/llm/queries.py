"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents")).drop("block")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import digest, quality_rules

    return digest(quality_rules(read_table(spark, sf_dir, "documents")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats, repeated_spans

    docs = read_table(spark, sf_dir, "documents")
    return remove_repeats(docs, repeated_spans(docs), keep_text=False)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(read_table(spark, sf_dir, "conversations"))


def op6_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import repeated_passages

    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import digest, remove_lines

    return digest(remove_lines(read_table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find

    return digest(find(read_table(spark, sf_dir, "documents")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, scan

    return digest(scan(read_table(spark, sf_dir, "documents")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .sql import oracle_sql

    return oracle_sql()
