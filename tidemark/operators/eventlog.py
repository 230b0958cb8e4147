"""Append-only logs: last write wins, merged metrics, gaps, frecency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.usage import normalize_usage
from tidemark.operators.ordered import neighbours

DAY_MS = 86_400_000
MAX_PATHS = 1000
METRIC_PREFIX = "_metric:"


def scan_event_log(
    log: DataFrame, log_id: int | str | None = None, after: int | None = None, before: int | None = None, limit: int | None = None
) -> DataFrame:
    """Entries of a log in order, with exclusive bounds on ``seq``."""
    if log_id is not None:
        log = log.where(F.col("log_id") == log_id)
    if after is not None:
        log = log.where(F.col("seq") > after)
    if before is not None:
        log = log.where(F.col("seq") < before)
    return log if limit is None else log.orderBy("log_id", "seq", "pos").limit(limit)


def compact_event_log(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Newest (kind, data) per (log_id, entity_key), with its (seq, pos).

    A ``snapshot`` is an earlier result: only entries after its last batch are
    folded in. Applying the same log twice changes nothing.
    """
    rows = log.select("log_id", "entity_key", "kind", "data", "seq", "pos")
    if snapshot is not None:
        last = snapshot.groupBy("log_id").agg(F.max("seq").alias("_last"))
        newer = rows.join(last, "log_id", "left").where(F.col("_last").isNull() | (F.col("seq") > F.col("_last")))
        rows = snapshot.select(*rows.columns).unionByName(newer.drop("_last"))
    newest = F.max_by(F.struct("kind", "data", "seq", "pos"), F.struct("seq", "pos"))
    return rows.groupBy("log_id", "entity_key").agg(newest.alias("_n")).select("log_id", "entity_key", "_n.*")


def latest_by_key(log: DataFrame, n: int | None = MAX_PATHS) -> DataFrame:
    """Last (frequency, last_open) written per path; the ``n`` opened last, or all."""
    newest = F.max_by(F.struct("frequency", "last_open"), "pos").alias("_n")
    latest = log.groupBy("path").agg(newest).select("path", "_n.*").orderBy(F.desc("last_open"), "path")
    return latest if n is None else latest.limit(n)


def frecency(log: DataFrame, now_ms: int) -> DataFrame:
    """How often and how lately each path was opened."""
    used = log.groupBy("path").agg(F.count("*").alias("frequency"), F.max("last_open").alias("last_open"))
    days = (F.lit(now_ms) - F.col("last_open")) / F.lit(DAY_MS)
    return used.withColumn("score", F.col("frequency") * (1 / (1 + days)))


def tail_n(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries, oldest first."""
    return log.orderBy(F.desc("seq"), F.desc("pos")).limit(n).orderBy("seq", "pos")


def log_gaps(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``gap_ms``: milliseconds since the previous line, 0 for the first."""
    found = neighbours(logs, keys, ["ts", "seq", "pos"], F.unix_millis("ts"))
    return found.select(*logs.columns, F.coalesce(F.unix_millis("ts") - F.col("previous"), F.lit(0)).alias("gap_ms"))


def _metric_fields(message: Column) -> Column:
    text = F.when(F.startswith(message, F.lit(METRIC_PREFIX)), F.substr(message, F.lit(len(METRIC_PREFIX) + 1)))
    return F.from_json(text, "map<string,string>")


def merge_metrics(logs: DataFrame) -> DataFrame:
    """One map per request from its metric lines (request_id, pos, message); later keys win."""
    rows = logs.select("request_id", "pos", F.explode(_metric_fields(F.col("message"))).alias("key", "value"))
    latest = rows.groupBy("request_id", "key").agg(F.max_by(F.struct("value"), "pos").alias("v"))
    # One entry per metric name.
    return latest.groupBy("request_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "v.value")))).alias("metrics")
    )


def trace_metrics(traces: DataFrame, base: dict[str, Column]) -> DataFrame:
    """One map per trace: ``base`` fields, then the metric lines of ``logs`` in order."""
    start = F.map_filter(
        F.create_map(*[x for k, c in base.items() for x in (F.lit(k), c.cast("string"))]), lambda k, v: v.isNotNull()
    )

    def fold(acc: Column, message: Column) -> Column:
        fields = _metric_fields(message)
        merged = F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(fields, k)), fields)
        return F.when(fields.isNull(), acc).otherwise(merged)

    return traces.withColumn("metrics", F.aggregate("logs", start, fold)).drop("logs")


def _usage_payload(chunk: Column, wire: str) -> Column:
    """Usage object inside one streamed chunk, or null."""
    lines = F.split(chunk, "\n")
    after = lambda line: F.when(F.startswith(line, F.lit("data: ")), F.substr(line, F.lit(7)))
    if wire == "anthropic":
        data = after(F.get(lines, F.lit(1)))
        return F.coalesce(F.get_json_object(data, "$.usage"), F.get_json_object(data, "$.message.usage"))
    if wire == "openai":
        data = F.when(F.get(lines, F.lit(0)) == "event: response.completed", after(F.get(lines, F.lit(1))))
        return F.get_json_object(data, "$.response.usage")
    data = after(chunk)
    return F.get_json_object(data, "$.usageMetadata" if wire == "google" else "$.usage")


def merge_usage_deltas(chunks: DataFrame, wire: str) -> DataFrame:
    """Token counts per request from its streamed chunks (request_id, seq, chunk).

    One wire format sends the counts in pieces, merged field by field; in the
    others the last usage object stands for all.
    """
    rows = chunks.select("request_id", "seq", _usage_payload(F.col("chunk"), wire).alias("payload"))
    rows = rows.where(F.col("payload").isNotNull())
    if wire == "anthropic":
        paths = {
            "input_tokens": "$.input_tokens",
            "output_tokens": "$.output_tokens",
            "cache_read_input_tokens": "$.cache_read_input_tokens",
            "five": "$.cache_creation.ephemeral_5m_input_tokens",
            "hour": "$.cache_creation.ephemeral_1h_input_tokens",
        }
        fields = rows.select("request_id", "seq", *[F.get_json_object("payload", p).cast("long").alias(n) for n, p in paths.items()])
        last = fields.groupBy("request_id").agg(
            *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in paths]
        )
        cache = F.struct(F.col("five").alias("ephemeral_5m_input_tokens"), F.col("hour").alias("ephemeral_1h_input_tokens"))
        payload = F.to_json(
            F.struct("input_tokens", "output_tokens", "cache_read_input_tokens", cache.alias("cache_creation"))
        )
        merged = last.select("request_id", payload.alias("payload"))
    else:
        merged = rows.groupBy("request_id").agg(F.max_by("payload", "seq").alias("payload"))
    return merged.select("request_id", normalize_usage(F.col("payload"), F.lit(wire)).alias("u")).select("request_id", "u.*")
