"""Token counts from provider payloads, and weighted choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_FIELDS = (
    "input_tokens",
    "output_tokens",
    "reasoning_tokens",
    "cache_read_tokens",
    "cache_write_5m_tokens",
    "cache_write_1h_tokens",
)


def _number(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path).cast("long")


def normalize_usage(payload: Column, wire: Column) -> Column:
    """One struct of six counts from four payload shapes.

    ``wire`` is ``anthropic``, ``openai``, ``oa-compat`` or ``google``. Cached
    input is part of the input count in the last three and is taken out;
    reasoning is taken out of the output only for ``openai``.
    """
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")

    def shape(inp, out, reasoning, read, write_5m=none, write_1h=none) -> Column:
        columns = (inp, out, reasoning, read, write_5m, write_1h)
        return F.struct(*[c.alias(name) for c, name in zip(columns, TOKEN_FIELDS)])

    def n(path: str) -> Column:
        return _number(payload, path)

    def z(path: str) -> Column:
        return F.coalesce(n(path), zero)

    cached = n("$.input_tokens_details.cached_tokens")
    thought = n("$.output_tokens_details.reasoning_tokens")
    shared = F.coalesce(n("$.cached_tokens"), n("$.prompt_tokens_details.cached_tokens"))
    return (
        F.when(
            wire == "anthropic",
            shape(
                z("$.input_tokens"),
                z("$.output_tokens"),
                none,
                n("$.cache_read_input_tokens"),
                n("$.cache_creation.ephemeral_5m_input_tokens"),
                n("$.cache_creation.ephemeral_1h_input_tokens"),
            ),
        )
        .when(
            wire == "openai",
            shape(
                z("$.input_tokens") - F.coalesce(cached, zero),
                z("$.output_tokens") - F.coalesce(thought, zero),
                thought,
                cached,
            ),
        )
        .when(
            wire == "google",
            shape(
                z("$.promptTokenCount") - z("$.cachedContentTokenCount"),
                z("$.candidatesTokenCount"),
                z("$.thoughtsTokenCount"),
                z("$.cachedContentTokenCount"),
            ),
        )
        .otherwise(
            shape(
                z("$.prompt_tokens") - F.coalesce(shared, zero),
                z("$.completion_tokens"),
                n("$.completion_tokens_details.reasoning_tokens"),
                shared,
            )
        )
    )


def _finite(value: Column) -> Column:
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(number)


def session_tokens(
    inp: Column, output: Column, reasoning: Column, cached: Column, cache_write: Column, excludes_cached: Column
) -> Column:
    """Counts of one step. Cached input is subtracted unless the provider already left it out."""
    base = F.coalesce(inp.cast("double"), F.lit(0.0))
    read = F.coalesce(cached.cast("double"), F.lit(0.0))
    return F.struct(
        _finite(F.when(excludes_cached, base).otherwise(base - read)).cast("long").alias("input"),
        _finite(output).cast("long").alias("output"),
        _finite(reasoning).cast("long").alias("reasoning"),
        _finite(read).cast("long").alias("cache_read"),
        _finite(cache_write).cast("long").alias("cache_write"),
    )


def id_hash(identifier: Column) -> Column:
    """Unsigned 32-bit polynomial hash (base 31) of the last four characters."""
    tail = F.filter(F.split(F.right(identifier, F.lit(4)), ""), lambda ch: ch != "")
    return F.aggregate(
        tail,
        F.lit(0).cast("long"),
        lambda acc, ch: (acc * 31 + F.ascii(ch)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")),
    )


def pick_weighted(identifier: Column, choices: Column) -> Column:
    """Name from array<struct<name, weight>>, the same one for the same id."""
    expanded = F.flatten(
        F.transform(choices, lambda c: F.array_repeat(c["name"], F.coalesce(c["weight"], F.lit(1)).cast("int")))
    )
    position = F.pmod(id_hash(identifier), F.size(expanded).cast("long")) + 1
    return F.when(F.size(expanded) > 0, F.try_element_at(expanded, position.cast("int")))
