"""Token counts through a digest cache.

Every text is keyed by the SHA-256 of its content and of the tokenizer's file. Counts that the cache table
has are joined; of the rest, each distinct text is encoded once, wherever its copies are, and its count is
appended to the cache. Normalised content is the UTF-8 text itself with null as empty: anything stronger
(case, Unicode forms) would change byte-level counts.

Null and empty texts count 0 tokens, repeated rows are each returned, long texts are encoded whole, an
empty table gives an empty table. The cache is append-only Parquet; two writers may append the same digest,
which the reader's `min` makes harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phantomlake.llm.common import exists, id_text, written
from phantomlake.llm.tokens import ChunkEncoder, grouped, texts_of, version_digest

COUNTS = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
CACHE = "digest binary, n_tokens long, version string"


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; empty where the cache does not exist yet."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encoded(misses: DataFrame, tokenizer: str) -> DataFrame:
    """digest, n_tokens of (digest, text) rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer)
        for table in grouped(parts):
            digests = table.column("digest").combine_chunks().cast(pa.binary())
            yield pa.RecordBatch.from_arrays([digests, pa.array(encoder.counts(texts_of(table)))], schema=COUNTS)

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; counts of texts that the cache lacks are appended to it."""
    spark, version = docs.sparkSession, version_digest(tokenizer)
    keyed = id_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]).join(cached_counts(spark, cache, version), "digest", "left_anti")
    encoded(misses, tokenizer).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    slim = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # as a table of its own, so that AQE can split a digest that very many rows have
    counts = written(cached_counts(spark, cache, version), "token-counts")
    joined = slim.join(counts, "digest", "left")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
