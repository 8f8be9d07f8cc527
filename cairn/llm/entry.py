"""The queries of this subpackage: each applies one operator to its whole table and derives the columns it is asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import fm_decontam, importance, langid, lattice, license, maglev, minhash, packing, radix_dedup, wordpiece
from cairn.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "RANKS", "TOKENIZER"]

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license.scan(read(spark, sf, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.near_vectors(read(spark, sf, "embeddings"))


def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return maglev.place(read(spark, sf, "documents").select("doc_id"), "doc_id", maglev.names())


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = radix_dedup.remove_repeats(read(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return wordpiece.count_tokens(read(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(read(spark, sf, "documents"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = fm_decontam.find(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return importance.score(read(spark, sf, "documents"), read(spark, sf, "labels"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_minhash_dedup, op3_embedding_dedup, op4_sharding, op5_substring_dedup, op6_packing, op7_token_counts, op8_language_id, op9_decontamination, op10_quality)}
