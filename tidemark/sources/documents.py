"""Nested JSON documents: releases and the model catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELEASE = "tag_name string, name string, assets array<struct<name: string, download_count: bigint>>"
PRICE = "input: double, output: double, cache_read: double, cache_write: double"
CATALOGUE = (
    "map<string, struct<id: string, name: string, models: map<string, struct<id: string, name: string,"
    f" cost: struct<{PRICE}, context_over_200k: struct<{PRICE}>>,"
    " limit: struct<context: bigint, input: bigint, output: bigint>>>>>"
)


def scan_releases(df: DataFrame) -> DataFrame:
    """One row per asset of the release documents in ``value``."""
    parsed = df.select(F.from_json("value", RELEASE).alias("r"))
    return parsed.select("r.tag_name", F.explode("r.assets").alias("a")).select(
        F.col("tag_name").alias("tag"), F.col("a.name").alias("asset"), F.col("a.download_count").alias("downloads")
    )


def scan_model_catalogue(df: DataFrame) -> DataFrame:
    """One row per model of the provider maps in ``value``, with prices and limits."""
    providers = df.select(F.explode(F.from_json("value", CATALOGUE)).alias("provider_id", "p"))
    models = providers.select("provider_id", F.explode("p.models").alias("model_id", "m"))
    return models.select(
        "provider_id",
        "model_id",
        F.col("m.name").alias("name"),
        *[F.col(f"m.cost.{c}").alias(f"{c}_price") for c in ("input", "output", "cache_read", "cache_write")],
        *[F.col(f"m.cost.context_over_200k.{c}").alias(f"tier_{c}_price") for c in ("input", "output", "cache_read", "cache_write")],
        *[F.col(f"m.limit.{c}").alias(f"{c}_limit") for c in ("context", "input", "output")],
    )


def rank_models(models: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """Models by place in the priority list (later entries first), then "latest", then id, descending.

    A priority entry is a part of a model id; the first one found in an id is its place.
    """
    place = F.lit(-1)
    for i, part in reversed(list(enumerate(priority))):
        place = F.when(F.contains("model_id", F.lit(part)), i).otherwise(place)
    latest = F.when(F.contains("model_id", F.lit("latest")), 0).otherwise(1)
    return models.withColumns({"place": place, "latest": latest}).orderBy(F.desc("place"), "latest", F.desc("model_id"))
