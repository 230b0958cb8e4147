"""The registered queries of this subpackage: one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, lines, mixing, pages, shards, simhash, spelling, substring, suffixes, tokens, topk, whitening
from tidemark.session import scratch_dir


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, path, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op2_html_extraction(spark: SparkSession, path: str) -> DataFrame:
    return pages.extract(_table(spark, path, "pages"))


def op3_language(spark: SparkSession, path: str) -> DataFrame:
    return langid.language_report(_table(spark, path, "documents"))


def op4_decontamination(spark: SparkSession, path: str) -> DataFrame:
    return decontam.leak_report(_table(spark, path, "documents"), _table(spark, path, "benchmark"))


def op5_simhash(spark: SparkSession, path: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, path, "documents"))


def op6_tokens(spark: SparkSession, path: str) -> DataFrame:
    return tokens.token_table(_table(spark, path, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_substring(spark: SparkSession, path: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, path, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op8_topk(spark: SparkSession, path: str) -> DataFrame:
    return topk.nearest(_table(spark, path, "embeddings"))


def op9_mixture(spark: SparkSession, path: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, path, "documents"))


def op10_suffix_array(spark: SparkSession, path: str) -> DataFrame:
    kept = suffixes.remove_repeats(_table(spark, path, "documents"), digest=True)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def op11_whitening(spark: SparkSession, path: str) -> DataFrame:
    return whitening.whiten(_table(spark, path, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_spelling(spark: SparkSession, path: str) -> DataFrame:
    return spelling.variants(_table(spark, path, "documents"))


def op13_shards(spark: SparkSession, path: str) -> DataFrame:
    written = shards.write_shards(_table(spark, path, "documents"), scratch_dir(spark, "shards"))
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return written.select("doc_id", "size", checksum.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_html_extraction,
        op3_language,
        op4_decontamination,
        op5_simhash,
        op6_tokens,
        op7_substring,
        op8_topk,
        op9_mixture,
        op10_suffix_array,
        op11_whitening,
        op12_spelling,
        op13_shards,
    )
}
ORACLES: dict[str, str] = {"op1_line_dedup": lines.ORACLE, "op4_decontamination": decontam.ORACLE, "op8_topk": topk.ORACLE}
