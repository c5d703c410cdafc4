"""The registered queries, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contain, html_hosts, mixing, ngram_trie, quality_ledger, rlz, secrets_rf, simhash, simple8b, sql, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_rf.find_secrets(spark, _read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _read(spark, sf_dir, "documents")).drop("times")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(spark, _read(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score_documents(spark, _read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.assess(_read(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_hosts.extract(spark, _read(spark, sf_dir, "pages"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.tokenize(spark, _read(spark, sf_dir, "documents"), tokenizer_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.dedup_spans(spark, _read(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.find_items(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


ALL: tuple[Query, ...] = (
    op1_simhash_near_dedup,
    op2_secret_scan,
    op3_source_mixing,
    op4_suffix_array_dedup,
    op5_lm_scoring,
    op6_quality_rules,
    op7_html_extraction,
    op8_token_output,
    op9_substring_dedup,
    op10_benchmark_decontamination,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
