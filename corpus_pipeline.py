"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
it kept; its result is written as Parquet into the shared folder and read
back as the next stage's docs. All but the last return the columns of
documents, others besides included, whatever their names. An empty table
stays empty through all stages; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import contain, mixing, quality_ledger, simhash, simple8b
from sylvan.llm.queries import tokenizer_path
from sylvan.llm.shared import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go, so null and empty texts do; null
    or repeated ids don't matter, equal rows share their fate."""
    return quality_ledger.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: of the least id, null
    last, ties by a hash of id and text; repeated rows are one."""
    return simhash.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts, and
    null or empty items, match nothing."""
    return contain.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them. A null source is a
    source; rows of one id, so all of the null id, are taken alike."""
    return mixing.take(spark, docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, which stay in the shared folder, and a row per document
    read back from them: null ids first, ties in the order of a hash of the
    text; a null text has the end id alone."""
    return simple8b.tokenize(spark, docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Fingerprints and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(spark, docs, name)
    return docs
