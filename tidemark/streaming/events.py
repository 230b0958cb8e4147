"""Stateless and windowed stream operators.

Each takes a streaming (or batch) DataFrame with a TIMESTAMP ``ts`` and gives a
DataFrame; ``run`` and ``upsert`` attach sinks. Where the order of writes
matters it is (seq, pos), never arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.time import id_timestamp
from tidemark.operators.eventlog import compact_event_log
from tidemark.sources.entities import read_entities, write_entities

# Fixed values.
ABORTED = "Tool execution aborted"
RETENTION_DAYS = 7


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet, taking what is there and stopping."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode(mode).trigger(availableNow=True).start()


def upsert(df: DataFrame, keys: list[str], root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the latest value per key of an update-mode stream in the store ``root/rows``.

    Results are there at once and are corrected by late data, where append mode
    would wait for the watermark.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"id": F.to_json(F.struct(*keys)), "batch": F.lit(batch_id)}).persist()
        write_entities(rows, root, "rows", version="batch", buckets=buckets)
        rows.unpersist()

    writer = df.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def upserted(spark: SparkSession, root: str) -> DataFrame:
    return read_entities(spark, root, "rows").drop("id", "batch")


def subscribe(stream: DataFrame, kind: str | None = None) -> DataFrame:
    """Events of one topic, or of all."""
    return stream if kind is None else stream.where(F.col("kind") == kind)


def batch_changes(stream: DataFrame, every: str = "1 second", watermark: str = "1 minute") -> DataFrame:
    """A log's changes in batches of ``every``: the last write per entity, one row each.

    A batch is the rows that share (log_id, start). They stay rows, so a busy
    log does not become one huge cell.
    """
    window = F.window("ts", every)
    newest = F.max_by(F.struct("kind", "data", "seq", "pos"), F.struct("seq", "pos"))
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(window.alias("w"), "log_id", "entity_key")
        .agg(newest.alias("n"))
        .select("log_id", F.col("w.start").alias("start"), "entity_key", "n.*")
    )


def stream_compaction(stream: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the newest value per entity in the store ``root/log``.

    A micro-batch is reduced first and then merged by version, so one that runs
    again after a failure changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        key = F.concat(F.col("log_id").cast("string"), F.lit("/"), "entity_key")
        rows = compact_event_log(batch).withColumns({"id": key, "version": F.struct("seq", "pos")}).persist()
        write_entities(rows, root, "log", version="version", buckets=buckets)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def compacted(spark: SparkSession, root: str) -> DataFrame:
    return read_entities(spark, root, "log").drop("id", "version")


def stream_ip_limits(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Requests per ip in each three-hour stretch, moving by an hour."""
    window = F.window("ts", "3 hours", "1 hour")
    return (
        stream.withWatermark("ts", watermark)
        .groupBy("ip", window.alias("w"))
        .agg(F.count("*").alias("count"))
        .select("ip", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")
    )


def stream_ip_hours(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Requests per ip and clock hour."""
    return (
        stream.withWatermark("ts", watermark)
        .groupBy("ip", F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("count"))
        .select("ip", F.date_format("w.start", "yyyyMMddHH").alias("interval"), "count")
    )


def session_status(stream: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the newest status per session in the store ``root/status``: (session_id, seq, pos, status).

    Nothing is kept in the stream itself. A micro-batch is reduced to one row per
    session and merged by (seq, pos), so one that runs again changes nothing. An
    ``idle`` session stays in the store as a tombstone: an older event that comes
    later does not bring it back.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        at = F.struct("seq", "pos")
        newest = batch.groupBy("session_id").agg(F.max_by(F.struct("seq", "pos", "status"), at).alias("n")).select("session_id", "n.*")
        rows = newest.withColumns({"id": F.col("session_id").cast("string"), "version": at}).persist()
        write_entities(rows, root, "status", version="version", buckets=buckets)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def statuses(spark: SparkSession, root: str) -> DataFrame:
    """The sessions of ``session_status`` that are not idle."""
    return read_entities(spark, root, "status").where("status <> 'idle'").select("session_id", "seq", "pos", "status")


def assemble_text(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Append the deltas (part_id, seq, delta) of each micro-batch to ``root``, as one sorted chunk per part.

    No state is kept: a late delta is one more chunk. A micro-batch has a folder of its
    own, which it replaces if it runs again.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        chunks = batch.groupBy("part_id").agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("deltas"))
        chunks.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def assembled(spark: SparkSession, root: str) -> DataFrame:
    """(part_id, text) of what ``assemble_text`` has written: each part's chunks merged, without white space at the end."""
    spaces = F.lit(" \t\n\x0b\f\r")
    parts = spark.read.parquet(root).groupBy("part_id").agg(F.sort_array(F.flatten(F.collect_list("deltas"))).alias("d"))
    return parts.select("part_id", F.rtrim(F.array_join("d.delta", ""), spaces).alias("text"))


def request_timings(stream: DataFrame, every: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Time to first byte, bytes and last byte per request, from its chunks.

    ``started`` is when the request came in, the same for all its chunks.
    """
    return (
        stream.withWatermark("started", watermark)
        .groupBy("request_id", F.window("started", every).alias("w"))
        .agg(F.min("started").alias("begun"), F.min("ts").alias("first_byte"), F.sum(F.length("chunk")).alias("response_length"), F.max("ts").alias("last_byte"))
        .select(
            "request_id",
            (F.unix_millis("first_byte") - F.unix_millis("begun")).alias("time_to_first_byte_ms"),
            "response_length",
            F.unix_millis("last_byte").alias("last_byte_ms"),
        )
    )


def close_dangling(parts: DataFrame, ended: DataFrame) -> DataFrame:
    """Tool parts still open in messages that have ended, turned into errors."""
    open_call = (F.col("type") == "tool") & ~F.col("status").isin("completed", "error")
    over = ended.select("message_id", F.lit(True).alias("_ended"))
    joined = parts.join(over, "message_id", "left").withColumn("_close", open_call & F.coalesce("_ended", F.lit(False)))
    return joined.select(
        *[
            F.when(F.col("_close"), "error").otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(F.col("_close"), ABORTED).otherwise(F.col(c)).alias(c)
            if c == "error"
            else F.col(c)
            for c in parts.columns
        ]
    )


def expire_outputs(files: DataFrame, now_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Stored outputs not older than ``days`` by the time in their id."""
    return files.where(id_timestamp(F.col("id"), F.lit(now_ms)) >= now_ms - days * 86_400_000)
