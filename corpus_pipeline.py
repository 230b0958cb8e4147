"""The corpus pipeline: from raw documents to token blocks.

Each stage works on all that the one before kept, written as Parquet and read again.
All but the last return the columns of ``documents``.

Defined results: null, empty and letterless texts have no language and end at the first
stage; a null ``doc_id``, ``source`` or ``lang`` is a value like any other; repeated rows
are copies, of which near-dedup keeps one; ties go to the smaller id, null first, and then
to the text's hash; texts of any length are read whole, one row in one task; other columns
stay with their row whatever their names are; empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, mixing, nearcopies, tokens
from tidemark.llm.common import stored

#: Below this relative distance of the two best languages a text counts as of neither.
LANGUAGE_MARGIN = 0.0005


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: neither without letters nor torn between two."""
    return langid.identify(docs, langid.learn(docs.select("doc_id", "text", "lang")), LANGUAGE_MARGIN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles), the first by id and text hash."""
    return nearcopies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), partial=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks in the shared folder, and place, length and checksum of each document read back from them."""
    return tokens.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token output", token_blocks),
]

#: Language prediction and token ids have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
