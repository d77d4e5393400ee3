"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phantomlake.llm import cleaning, conversation_repair, decontaminate, license_scan, line_crf, near_dedup, packing, pii, ppm, prefix_trie, token_counts, token_files, url_filter
from phantomlake.llm.common import documents, new_path, written
from phantomlake.llm.tokens import default_tokenizer


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_crf.classify(docs, line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), default_tokenizer("byte_bpe_50k.json"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), threshold=85)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.quality_rules(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every run does all the work."""
    return token_counts.token_counts(documents(spark, sf_dir), default_tokenizer("byte_bpe_50k.json"), new_path(spark, "token-cache"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    manifest = written(token_files.write_shards(documents(spark, sf_dir), path, default_tokenizer("word_bpe_49k.json")), "token-manifest")
    return token_files.read_shards(spark, path, manifest)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.pii_report(docs, pii.fit(docs))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, present = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair_report(rows, present).drop("n_rows")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_license_scan": op2_license_scan,
        "op3_ppm_score": op3_ppm_score,
        "op4_line_crf": op4_line_crf,
        "op5_decontaminate": op5_decontaminate,
        "op6_packing": op6_packing,
        "op7_near_dedup": op7_near_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_token_files": op10_token_files,
        "op11_pii": op11_pii,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.oracle_sql(),
        "op7_near_dedup": near_dedup.oracle_sql(),
        "op8_quality_rules": cleaning.oracle_sql(),
        "op12_conversation_repair": conversation_repair.oracle_sql(),
        "op13_prefix_trie": prefix_trie.oracle_sql(),
    }
