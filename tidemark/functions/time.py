"""Time functions. All buckets are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_WRAP_MS = 1 << 36


def hour_bucket(ts: Column) -> Column:
    """``yyyymmddhh`` as text."""
    return F.date_format(ts, "yyyyMMddHH")


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_seconds(ts) / 3600).cast("long")


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the week."""
    return F.date_trunc("week", ts)


def week_bounds(ts: Column) -> Column:
    start = week_start(ts)
    return F.struct(start.alias("start"), (start + F.expr("INTERVAL 7 DAYS")).alias("end"))


def id_timestamp(identifier: Column, reference_ms: Column | None = None) -> Column:
    """Milliseconds held in a sortable id (12 hex digits after the prefix).

    An id keeps time modulo 2^36 ms. With ``reference_ms`` the result is moved
    to the latest such instant that is not after the reference.
    """
    digits = F.substring(F.substring_index(identifier, "_", -1), 1, 12)
    low = F.floor(F.conv(digits, 16, 10).cast("decimal(20,0)") / 4096).cast("long")
    if reference_ms is None:
        return low
    return reference_ms - F.pmod(reference_ms - low, F.lit(ID_WRAP_MS))


def quota_status(usage: Column, updated: Column, limit: Column, now: Column, window_seconds: int | None) -> Column:
    """Struct(status, reset_in_sec, usage_percent) of a quota.

    ``window_seconds`` gives an anchored window opened at ``updated``; ``None``
    is the calendar week of ``now``. ``limit`` is in micro-cents.
    """
    seconds = lambda ts: F.unix_micros(ts) / F.lit(1_000_000)
    if window_seconds is None:
        start = seconds(week_start(now))
        end = start + 7 * 86400
        idle_reset = F.ceil(end - seconds(now))
    else:
        start = seconds(now) - window_seconds
        end = seconds(updated) + window_seconds
        idle_reset = F.lit(window_seconds)
    stale = seconds(updated) < start
    reset = F.when(stale, idle_reset).otherwise(F.ceil(end - seconds(now))).cast("long")
    limited = ~stale & (usage >= limit)
    percent = F.when(stale, 0).when(limited, 100).otherwise(F.ceil(F.least(F.lit(100.0), usage / limit * 100)))
    return F.struct(
        F.when(limited, "rate-limited").otherwise("ok").alias("status"),
        reset.alias("reset_in_sec"),
        percent.cast("long").alias("usage_percent"),
    )


def retry_text(seconds: Column) -> Column:
    """Waiting time as ``2 days``, ``3hr 5min`` or ``7min``."""
    days = F.floor(seconds / 86400)
    hours = F.floor(seconds / 3600)
    minutes = F.ceil(F.pmod(seconds, F.lit(3600)) / 60)
    return (
        F.when(days >= 1, F.concat(days.cast("string"), F.when(days > 1, " days").otherwise(" day")))
        .when(hours >= 1, F.concat(hours.cast("string"), F.lit("hr "), minutes.cast("string"), F.lit("min")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("min")))
    )
