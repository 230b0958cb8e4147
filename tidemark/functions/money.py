"""Money. Amounts are BIGINT micro-cents: one dollar is 100 000 000."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO_PER_CENT = 1_000_000
MICRO_PER_DOLLAR = 100_000_000


def round_half_up(value: Column) -> Column:
    """Round to an integer, halves upwards (also below zero)."""
    return F.floor(value + F.lit(0.5)).cast("long")


def cents_to_micro(cents: Column) -> Column:
    return round_half_up(cents * MICRO_PER_CENT)


def micro_to_dollars(amount: Column) -> Column:
    return (amount.cast("decimal(20,0)") / F.lit(MICRO_PER_DOLLAR).cast("decimal(10,0)")).cast("decimal(28,8)")


def processing_fee(cents: Column) -> Column:
    """Card fee in cents on top of ``cents``: 4.4 % plus 30 of the grossed-up sum."""
    return round_half_up((cents + 30) / F.lit(0.956) * F.lit(0.044) + 30)
