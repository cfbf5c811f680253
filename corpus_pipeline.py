"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoscape.llm.common import drop_table, materialize, private, read_table
from chronoscape.llm.decontamination import remove_leaks
from chronoscape.llm.line_dedup import remove_lines
from chronoscape.llm.near_duplicates import keep_first
from chronoscape.llm.packing import pack_documents
from chronoscape.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules (null and empty texts do) or are robust outliers of their language and
    source (nulls are a language or source of their own). Rows that are equal stay or go together."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts boilerplate lines out of the texts; every document stays. Null text stays null; n_chars follows the text."""
    counts = private(docs, "lines", "removed")
    cut = remove_lines(docs, counts=tuple(counts))
    n_chars = F.when(F.col(counts[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates: the least doc_id, and one of rows that are equal. Rows
    without doc_id take part by their text; texts without words link with nothing and stay."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text leaks a benchmark item; null texts and items match nothing."""
    return remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens; null text is the closing id alone, and repeated rows
    are packed as often as they occur."""
    return pack_documents(docs).drop("block")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: Robust covariance and edit matching have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row. Columns besides those of documents pass through up to the last stage; empty tables give
    empty results. A stage's table is deleted once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            drop_table(before)
        before = docs
    return docs
