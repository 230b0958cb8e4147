"""Stream queries: each reads a table as a stream, lands the result, and reads it back."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import eventlog as E
from tidemark.operators.pending import pending_requests
from tidemark.plans.corpus import wildcard_sql
from tidemark.plans.events import listed
from tidemark.plans.ledger import HOURS, _ROLLING
from tidemark.plans.registry import ORACLES, query
from tidemark.plans.views import NOW_MS, Views
from tidemark.session import ROCKSDB, scratch_dir
from tidemark.streaming import events as S
from tidemark.streaming import state as K


@contextmanager
def _state_settings(v: Views):
    """RocksDB state, and on a small machine no more state partitions than it can use."""
    conf = v.spark.conf
    partitions = int(conf.get("spark.sql.shuffle.partitions"))
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.shuffle.partitions": str(min(partitions, v.spark.sparkContext.defaultParallelism)),
    }
    before = {k: conf.get(k, None) for k in wanted}
    for k, value in wanted.items():
        conf.set(k, value)
    try:
        yield
    finally:
        for k, value in before.items():
            conf.unset(k) if value is None else conf.set(k, value)


def landed(v: Views, stream: DataFrame) -> DataFrame:
    root = scratch_dir(v.spark, "stream")
    with _state_settings(v):
        S.run(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{root}/out")


def upserted(v: Views, stream: DataFrame, keys: list[str]) -> DataFrame:
    root = scratch_dir(v.spark, "stream")
    with _state_settings(v):
        S.upsert(stream, keys, root, f"{root}/checkpoint", buckets=8).awaitTermination()
    return S.upserted(v.spark, root)


@query("subscribe", "SELECT log_id, seq, pos, kind FROM v_log WHERE kind = 'click'")
def _(v: Views):
    stream = v.event_log(v.stream("events"))
    return landed(v, S.subscribe(stream, "click").select("log_id", "seq", "pos", "kind"))


@query(
    "batch_changes",
    """SELECT log_id, epoch_us(date_trunc('second', ts)) // 1000000 AS start, entity_key, arg_max(data, seq * 10 + pos) AS data, max(seq * 10 + pos) AS last
       FROM v_log GROUP BY 1, 2, 3""",
)
def _(v: Views):
    rows = upserted(v, S.batch_changes(v.event_log(v.stream("events"))), ["log_id", "start", "entity_key"])
    return rows.select("log_id", F.unix_seconds("start").alias("start"), "entity_key", "data", (F.col("seq") * 10 + F.col("pos")).alias("last"))


@query("stream_compaction", ORACLES["compact_event_log"])
def _(v: Views):
    root = scratch_dir(v.spark, "stream")
    S.stream_compaction(v.event_log(v.stream("events")), root, f"{root}/checkpoint", buckets=8).awaitTermination()
    return S.compacted(v.spark, root)


@query(
    "trace_metrics_stream",
    """SELECT event_id AS id, 'event_type=completions,' || event_type || '=' || json_extract_string(props, '$.k') AS metrics FROM events
       WHERE event_type > 'event_type'
       UNION ALL SELECT event_id, event_type || '=' || json_extract_string(props, '$.k') || ',event_type=completions' FROM events WHERE event_type < 'event_type'""",
)
def _(v: Views):
    line = F.concat(F.lit('_metric:{"'), "event_type", F.lit('":'), F.get_json_object("props", "$.k"), F.lit("}"))
    traces = v.stream("events").select(F.col("event_id").alias("id"), F.array(F.lit("note"), line).alias("logs"))
    merged = E.trace_metrics(traces, {"event_type": F.lit("completions")})
    return landed(v, merged).withColumn("metrics", listed("metrics"))


@query(
    "stream_ip_limits",
    """SELECT ip, start, count(*) AS count FROM (
         SELECT ip, unnest([epoch_us(ts) // 3600000000 - 2, epoch_us(ts) // 3600000000 - 1, epoch_us(ts) // 3600000000]) AS start FROM v_usage) GROUP BY 1, 2""",
)
def _(v: Views):
    rows = upserted(v, S.stream_ip_limits(v.usage(v.stream("events"))), ["ip", "start"])
    return rows.select("ip", F.floor(F.unix_seconds("start") / 3600).cast("long").alias("start"), "count")


@query("stream_ip_hours", ORACLES["hourly_ip_counts"])
def _(v: Views):
    return upserted(v, S.stream_ip_hours(v.usage(v.stream("events"))), ["ip", "interval"])


@query("stream_rolling_usage", f"WITH RECURSIVE {_ROLLING} SELECT id, user_id, anchor, rolling_usage FROM folded")
def _(v: Views):
    return landed(v, K.stream_rolling_usage(v.usage(v.stream("events")), HOURS))


@query(
    "session_status",
    """SELECT session_id, seq, status FROM (
         SELECT user_id AS session_id, max(event_id) AS seq, arg_max(CASE event_type WHEN 'purchase' THEN 'idle' WHEN 'error' THEN 'retry' ELSE 'busy' END, event_id) AS status
         FROM events GROUP BY 1) WHERE status <> 'idle'""",
)
def _(v: Views):
    status = F.when(F.col("event_type") == "purchase", "idle").when(F.col("event_type") == "error", "retry").otherwise("busy")
    stream = v.stream("events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("pos"), status.alias("status")
    )
    root = scratch_dir(v.spark, "stream")
    S.session_status(stream, root, f"{root}/checkpoint", buckets=8).awaitTermination()
    return S.statuses(v.spark, root).select("session_id", "seq", "status")


@query(
    "sticky_choice",
    """WITH g AS (SELECT event_id AS id, user_id AS session_id, ts, 'p' || (event_id % 3) AS own,
           CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
       i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, id) AS island FROM g)
       SELECT id, session_id, first_value(own) OVER (PARTITION BY session_id, island ORDER BY ts, id) AS provider FROM i""",
)
def _(v: Views):
    stream = v.stream("events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("p"), F.col("event_id") % 3).alias("provider"),
    )
    return landed(v, K.sticky_choice(stream))


def _deltas(conversations: DataFrame) -> DataFrame:
    words = conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("part_id"), F.posexplode(F.split("text", " ")).alias("seq", "word"))
    return words.select("part_id", "seq", F.concat("word", F.lit(" ")).alias("delta"))


@query(
    "assemble_text",
    "SELECT conv_id * 1000 + turn AS part_id, md5(rtrim(text, ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM conversations",
)
def _(v: Views):
    root = scratch_dir(v.spark, "stream")
    S.assemble_text(_deltas(v.stream("conversations")), f"{root}/parts", f"{root}/checkpoint").awaitTermination()
    return S.assembled(v.spark, f"{root}/parts").select("part_id", F.md5("text").alias("digest"))


@query(
    "request_timings",
    """SELECT event_id // 8 AS request_id, min(epoch_us(ts) // 1000) - epoch_us(date_trunc('day', ts)) // 1000 AS time_to_first_byte_ms,
         CAST(sum(length(props)) AS BIGINT) AS response_length, max(epoch_us(ts) // 1000) AS last_byte_ms FROM events GROUP BY event_id // 8, date_trunc('day', ts)""",
)
def _(v: Views):
    ts = F.col("ts").cast("timestamp")
    stream = v.stream("events").select(
        F.floor(F.col("event_id") / 8).cast("long").alias("request_id"), F.date_trunc("day", ts).alias("started"), ts.alias("ts"), F.col("props").alias("chunk")
    )
    return upserted(v, S.request_timings(stream, "1 day"), ["request_id", "last_byte_ms"])


@query(
    "close_dangling",
    """SELECT p.id, CASE WHEN open AND m.id IS NOT NULL THEN 'error' WHEN open THEN 'running' ELSE p.status END AS status,
         CASE WHEN open AND m.id IS NOT NULL THEN 'Tool execution aborted' ELSE p.error END AS error
       FROM (SELECT *, type = 'tool' AND status = 'completed' AND id % 3 = 0 AS open FROM v_parts) p
       LEFT JOIN v_messages m ON m.id = p.message_id AND m.role = 'assistant' AND m.session_id % 2 = 0""",
)
def _(v: Views):
    running = (F.col("type") == "tool") & (F.col("status") == "completed") & (F.col("id") % 3 == 0)
    parts = v.parts().withColumn("status", F.when(running, "running").otherwise(F.col("status")))
    ended = v.messages().where("role = 'assistant' AND session_id % 2 = 0").select(F.col("id").alias("message_id"))
    return S.close_dangling(parts, ended).select("id", "status", "error")


@query("expire_outputs", f"SELECT event_id FROM events WHERE epoch_us(ts) // 1000 >= {NOW_MS + 11 * 86400000} - 604800000")
def _(v: Views):
    encoded = F.pmod(F.unix_millis(F.col("ts").cast("timestamp")) * 4096 + 1, F.lit(1 << 48))
    text = F.concat(F.lit("tool_"), F.lpad(F.lower(F.hex(encoded)), 12, "0"), F.lit("abcdefghijklmn"))
    files = v.stream("events").select("event_id", text.alias("id"))
    return landed(v, S.expire_outputs(files, NOW_MS + 11 * 86400000).select("event_id"))


# -- permission requests ---------------------------------------------------------


def _permission_events(events: DataFrame) -> DataFrame:
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    reply = F.when(n % 40 == 2, "always").when(n % 50 == 3, "reject").when(n % 4 == 1, "once")
    none = F.lit(None).cast("array<string>")
    asked = F.struct(
        (n * 2).alias("seq"),
        F.lit("asked").alias("kind"),
        F.array(F.concat("event_type", F.lit("/"), k % 20), F.concat(F.lit("x/"), F.col("user_id") % 5)).alias("patterns"),
        F.array(F.concat("event_type", F.lit("/"), k % 2, F.lit("*")), F.concat(F.lit("x/"), F.col("user_id") % 5, F.lit(" *"))).alias("always"),
        F.lit(None).cast("string").alias("reply"),
    )
    answer = F.struct((n * 2 + 1).alias("seq"), F.lit("replied").alias("kind"), none.alias("patterns"), none.alias("always"), reply.alias("reply"))
    return events.select(
        (F.col("user_id") % 25).alias("session_id"), n.alias("id"), F.col("event_type").alias("permission"), F.explode(F.array(asked, answer)).alias("e")
    ).select("session_id", "id", "permission", "e.*").where("kind = 'asked' OR reply IS NOT NULL")


def _pending_sql(scoped: bool) -> str:
    own = "AND w.session_id = r.session_id" if scoped else ""
    return f"""
        WITH n AS (SELECT *, user_id % 25 AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              CASE WHEN event_id % 40 = 2 THEN 'always' WHEN event_id % 50 = 3 THEN 'reject' WHEN event_id % 4 = 1 THEN 'once' END AS reply FROM events),
        w AS (SELECT n.*, event_id * 2 AS seq FROM n LEFT JOIN (SELECT session_id, max(event_id) AS last FROM n WHERE reply = 'reject' GROUP BY 1) USING (session_id)
              WHERE reply IS NULL AND (last IS NULL OR last * 2 + 1 < event_id * 2)),
        p AS (SELECT event_id, session_id, seq, event_type AS permission, unnest([event_type || '/' || (k % 20), 'x/' || (user_id % 5)]) AS pattern FROM w),
        r AS (SELECT session_id, event_id * 2 + 1 AS at, event_type AS permission, unnest([event_type || '/' || (k % 2) || '*', 'x/' || (user_id % 5) || ' *']) AS rule FROM n WHERE reply = 'always'),
        d AS (SELECT DISTINCT permission, pattern{', session_id' if scoped else ''} FROM p),
        e AS (SELECT w.permission, w.pattern{', w.session_id' if scoped else ''}, min(r.at) AS since FROM d w JOIN r ON r.permission = w.permission {own}
                AND regexp_full_match(w.pattern, {wildcard_sql('r.rule')}, 's') GROUP BY ALL),
        c AS (SELECT event_id, p.session_id, seq, bool_and(since IS NOT NULL) AS every, max(since) AS since FROM p
              LEFT JOIN e ON e.permission = p.permission AND e.pattern = p.pattern {'AND e.session_id = p.session_id' if scoped else ''} GROUP BY 1, 2, 3),
        a AS (SELECT session_id, max(event_id * 2 + 1) AS last FROM n WHERE reply = 'always' GROUP BY 1)
        SELECT w.session_id, w.event_id AS id, w.event_type AS permission FROM w
        WHERE w.event_id NOT IN (SELECT event_id FROM c JOIN a USING (session_id) WHERE every AND last >= since AND last > seq)"""


@query("pending_requests", _pending_sql(False))
def _(v: Views):
    return pending_requests(_permission_events(v.table("events")))


@query("pending_requests_stream", _pending_sql(True))
def _(v: Views):
    changes = landed(v, K.stream_pending_requests(_permission_events(v.stream("events"))))
    last = changes.groupBy("session_id", "id").agg(F.max_by("state", F.struct("seq", F.col("state") != "pending")).alias("state"))
    names = v.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("permission"))
    return last.where("state = 'pending'").select("session_id", "id").join(names, "id")
