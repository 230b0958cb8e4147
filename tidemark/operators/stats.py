"""Statistics over all sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import running
from tidemark.operators.sessions import DAY_MS, cutoff_ms, filter_recent_sessions

TOKEN_SUMS = ("input", "output", "reasoning", "cache_read", "cache_write")


def _per_session(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    reply = F.col("role") == "assistant"
    sums = messages.groupBy("session_id").agg(
        F.count("*").alias("messages"),
        F.sum(F.when(reply, F.col("cost_nano"))).alias("cost_nano"),
        *[F.sum(F.when(reply, F.col(f"{n}_tokens"))).alias(n) for n in TOKEN_SUMS],
    )
    joined = sessions.select(F.col("id").alias("session_id"), "created", "updated").join(sums, "session_id", "left")
    return joined.na.fill(0, ["messages", "cost_nano", *TOKEN_SUMS])


def session_stats(
    sessions: DataFrame, messages: DataFrame, now_ms: int, days: int | None = None, project: int | str | None = None
) -> DataFrame:
    """One row of totals, range and averages over the chosen sessions."""
    chosen = filter_recent_sessions(sessions, now_ms, days, project)
    start = F.col("updated") if cutoff_ms(now_ms, days) > 0 else F.col("created")
    totals = _per_session(chosen, messages).agg(
        F.count("*").alias("sessions"),
        F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
        F.coalesce(F.sum("cost_nano"), F.lit(0)).alias("cost_nano"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_tokens") for n in TOKEN_SUMS],
        F.least(F.lit(now_ms), F.min(start)).alias("earliest"),
        F.coalesce(F.max("updated"), F.lit(now_ms)).alias("latest"),
    )
    range_days = F.greatest(F.lit(1), F.ceil((F.col("latest") - F.col("earliest")) / DAY_MS))
    if days is None:
        used = F.when(F.col("sessions") == 0, 0).otherwise(range_days)
    else:
        used = F.lit(max(days, 1))
    spoken = F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens")
    return totals.withColumn("days", used.cast("long")).withColumns(
        {
            "cost_per_day_nano": F.coalesce(F.try_divide("cost_nano", "days"), F.lit(0.0)),
            "tokens_per_session": F.coalesce(F.try_divide(spoken, F.col("sessions")), F.lit(0.0)),
        }
    )


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """Exact median of a whole-number column, as one row.

    Equal values are counted first, and the counts are accumulated over ranges of
    values, so no task has to hold all the rows.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    ranked = running(counts.withColumn("_all", F.lit(1)), ["_all"], [value], {"upto": ("sum", F.col("n"))})
    size = df.select(F.lit(1).alias("_all")).groupBy("_all").agg(F.count("*").alias("size"))
    low, high = F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1
    covers = lambda k: (F.col("upto") - F.col("n") < k) & (k <= F.col("upto"))
    return (
        ranked.join(size, "_all")
        .where(covers(low) | covers(high))
        .agg(((F.min(value) + F.max(value)) / 2).alias("median"))
    )


def median_tokens(
    sessions: DataFrame, messages: DataFrame, now_ms: int, days: int | None = None, project: int | str | None = None
) -> DataFrame:
    """Exact median of input + output + reasoning per session, sessions without any included."""
    chosen = filter_recent_sessions(sessions, now_ms, days, project)
    totals = _per_session(chosen, messages).select((F.col("input") + F.col("output") + F.col("reasoning")).alias("tokens"))
    return exact_median(totals, "tokens").select(F.coalesce("median", F.lit(0.0)).alias("median_tokens"))


def model_usage(messages: DataFrame) -> DataFrame:
    """Per provider/model. Output includes reasoning here."""
    return (
        messages.where("role = 'assistant'")
        .groupBy(F.concat("provider_id", F.lit("/"), "model_id").alias("model"))
        .agg(
            F.count("*").alias("messages"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input"),
            F.sum(F.coalesce("output_tokens", F.lit(0)) + F.coalesce("reasoning_tokens", F.lit(0))).alias("output"),
            F.coalesce(F.sum("cost_nano"), F.lit(0)).alias("cost_nano"),
        )
    )


def tool_usage(parts: DataFrame) -> DataFrame:
    """Calls per tool and their share of all calls in percent."""
    calls = parts.where("type = 'tool' AND tool <> ''").groupBy("tool").agg(F.count("*").alias("calls"))
    # One row per tool by now.
    total = F.sum("calls").over(Window.partitionBy(F.lit(1)))
    return calls.withColumn("percent", F.col("calls") / total * 100)


def top_models(messages: DataFrame, n: int) -> DataFrame:
    return model_usage(messages).orderBy(F.desc("messages"), "model").limit(n)


def top_tools(parts: DataFrame, n: int = 0) -> DataFrame:
    """Tools by calls; 0 gives all of them."""
    ordered = tool_usage(parts).orderBy(F.desc("calls"), "tool")
    return ordered.limit(n) if n else ordered
