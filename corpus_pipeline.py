"""The corpus pipeline: five stages, each reads what its predecessor kept as Parquet and decides for good."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phantomlake.llm import cleaning, decontaminate, line_crf, near_dedup, packing
from phantomlake.llm.common import documents, written
from phantomlake.llm.tokens import default_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that fail a rule, and documents that fail or lose too much."""
    return cleaning.clean_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose lines the conditional random field finds good. It learns from all of documents, those too that
    the rules have rejected, and from their texts as the rules leave them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_crf.good_documents(docs, line_crf.fit(documents(spark, sf_dir), labels, prepare=cleaning.clean_text))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies, which share 0.8 of their shingles or more."""
    return near_dedup.without_near_duplicates(docs, threshold=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, default_tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer cannot be written in SQL; tests hold each operator against brute force, and the chain to what each stage may keep.
ORACLE_SQL: str | None = None
