"""Queries through the extension surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.functions.extend import FunctionRegistry, Hooks
from tidemark.functions.text import estimate_tokens
from tidemark.plans.registry import query
from tidemark.plans.views import Views, tok


def _shout(text: pd.Series) -> pd.Series:
    return text.str.upper()


class _Words:
    def eval(self, text: str):
        for position, word in enumerate(text.split()):
            yield position, word


@query("register_function", "SELECT event_id, upper(event_type) AS loud FROM events")
def _(v: Views):
    registry = FunctionRegistry(v.spark)
    registry.register("shout", "event_type string", "string", _shout)
    return registry.call(v.table("events"), "shout", "loud").select("event_id", "loud")


@query(
    "register_table_function",
    "SELECT p_partkey, CAST(unnest(range(len(string_split(p_name, ' ')))) AS INTEGER) AS position, unnest(string_split(p_name, ' ')) AS word FROM part",
)
def _(v: Views):
    registry = FunctionRegistry(v.spark)
    registry.register_table("words", "text string", "position int, word string", _Words)
    v.table("part").createOrReplaceTempView("extend_part")
    return v.spark.sql("SELECT p.p_partkey, w.position, w.word FROM extend_part p, LATERAL words(p.p_name) w")


@query(
    "transform_hooks",
    f"SELECT conv_id, turn, lower(replace(text, '.', '!')) AS text, CAST({tok('text')} AS BIGINT) AS tokens FROM conversations WHERE role <> 'system'",
)
def _(v: Views):
    hooks = Hooks()
    hooks.on("message", lambda df: df.where("role <> 'system'"))
    hooks.on("message", lambda df: df.withColumn("tokens", estimate_tokens(F.col("text")).cast(LongType())))
    hooks.on("text", lambda df: df.withColumn("text", F.replace("text", F.lit("."), F.lit("!"))))
    hooks.on("text", lambda df: df.withColumn("text", F.lower("text")))
    messages = hooks.apply("message", v.table("conversations"))
    return hooks.apply("text", messages).select("conv_id", "turn", "text", "tokens")
