"""The queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe_codec, chunk_dedup, decontaminate, lang_id, near_dup, pii, quality, sharding, suffix_dedup, token_store
from tesserae.llm.oracle import SQL  # noqa: F401
from tesserae.llm.work import table


def op1_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("n_links")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_key(table(spark, sf_dir, "documents"), 16)


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("tid", "class_distance", "common_distance")


def removal(df: DataFrame, *more: str) -> DataFrame:
    """The digest of what a deduplication by spans returns, and more of its columns."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return df.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *more)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400), "passage_bytes")


def op6_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(chunk_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.read_tokens(spark, folder, ids=False)


def op10_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dup, op2_decontamination, op3_jump_sharding, op4_quality_divergence, op5_suffix_dedup, op6_pii_disclosure, op7_chunk_dedup, op8_language_id, op9_rans_tokens, op10_bpe_chunk_reuse)}
