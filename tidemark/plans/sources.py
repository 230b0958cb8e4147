"""Queries that write derived data to the shared folder and read it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.project import download_deltas
from tidemark.plans.registry import query
from tidemark.plans.views import Views
from tidemark.session import scratch_dir
from tidemark.sources import corpus, entities, logs, requests, tables

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query("scan_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NAMES))
def _(v: Views):
    found = tables.scan_tables(v.spark, v.path, NAMES)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in found.items()]
    return reduce(DataFrame.unionByName, counts)


@query("scan_entities", "SELECT 'project_id=' || project_id AS folder, id, title, updated FROM v_sessions")
def _(v: Views):
    root = scratch_dir(v.spark, "entities")
    sessions = v.sessions()
    sessions.write.partitionBy("project_id").json(f"{root}/session")
    schema = "id long, title string, updated long"
    found = entities.scan_entities(v.spark, root, "session", schema, one_per_file=False)
    return found.select(F.element_at("key", 1).alias("folder"), "id", "title", "updated")


@query(
    "write_entities",
    """SELECT id, CASE id % 3 WHEN 0 THEN 'new ' || title ELSE title END AS title, CASE id % 3 WHEN 0 THEN updated + 1 ELSE updated END AS updated FROM v_sessions
       UNION ALL SELECT id + 1000000, title, updated FROM v_sessions WHERE id % 3 = 2""",
)
def _(v: Views):
    root = scratch_dir(v.spark, "store")
    sessions = v.sessions().select("id", "title", "updated")
    entities.write_entities(sessions, root, "session", buckets=8)
    k = F.col("id") % 3
    changed = sessions.select(
        F.when(k == 2, F.col("id") + 1000000).otherwise(F.col("id")).alias("id"),
        F.when(k == 2, F.col("title")).otherwise(F.concat(F.lit("new "), "title")).alias("title"),
        F.when(k == 0, F.col("updated") + 1).when(k == 1, F.col("updated") - 1).otherwise(F.col("updated")).alias("updated"),
    )
    entities.write_entities(changed, root, "session", buckets=8)
    return entities.read_entities(v.spark, root, "session")


@query(
    "dump_requests",
    """SELECT 'data' AS copy, event_type AS model, strftime(ts, '%Y-%m-%d-%H') AS hour, count(*) AS n FROM events
       WHERE event_id % 13 <> 0 AND event_id % 10 <> 0 GROUP BY 2, 3
       UNION ALL SELECT 'meta', event_type, NULL, count(*) FROM events WHERE event_id % 13 <> 0 AND event_id % 10 <> 0 GROUP BY 2""",
)
def _(v: Views):
    root = scratch_dir(v.spark, "dump")
    requests.dump_requests(request_records(v), root, v.spark.sparkContext.defaultParallelism)
    part = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    hour = F.concat_ws("-", F.col("yyyy").cast("string"), part("mm"), part("dd"), part("hh"))
    schema = "request_id long, model string, yyyy string, mm string, dd string, hh string"
    data = v.spark.read.schema(schema).json(f"{root}/data").groupBy("model", hour.alias("hour")).agg(F.count("*").alias("n"))
    meta = v.spark.read.schema("request_id long, model string").json(f"{root}/meta").groupBy("model").agg(F.count("*").alias("n"))
    meta = meta.select(F.lit("meta").alias("copy"), "model", F.lit(None).cast("string").alias("hour"), "n")
    return data.select(F.lit("data").alias("copy"), "model", "hour", "n").unionByName(meta)


def request_records(v: Views):
    return v.table("events").select(
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("s"), "user_id")).otherwise("").alias("session_id"),
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("model"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("props").alias("request"),
        F.col("value").cast("string").alias("response"),
    )


@query("scan_stats_table", "SELECT * FROM v_series")
def _(v: Views):
    root = scratch_dir(v.spark, "stats")
    logs.stats_lines(download_deltas(v.series().withColumn("row", F.lit(0)))).write.text(root)
    return logs.scan_stats_table(v.spark, root)


@query(
    "scan_jsonl_tolerant",
    "SELECT entity_key AS path, seq AS frequency FROM v_log WHERE (seq * 10 + pos) % 7 <> 0",
)
def _(v: Views):
    root = scratch_dir(v.spark, "jsonl")
    entry = F.to_json(F.struct(F.col("entity_key").alias("path"), F.col("seq").alias("frequency")))
    broken = (F.col("seq") * 10 + F.col("pos")) % 7 == 0
    v.event_log().select(F.when(broken, F.lit('{"path":"x", broken')).otherwise(entry).alias("value")).write.text(root)
    return logs.scan_jsonl_tolerant(v.spark, root, "path string, frequency long")


@query(
    "scan_logs",
    """SELECT ['DEBUG', 'INFO', 'WARN', 'ERROR'][event_id % 4 + 1] AS level, epoch_us(date_trunc('second', ts)) // 1000000 AS second, event_id AS elapsed_ms,
         event_type AS service, CAST(user_id AS VARCHAR) AS "user", 'said ' || event_type || ' twice' AS message FROM events WHERE event_id % 9 <> 0""",
)
def _(v: Views):
    root = scratch_dir(v.spark, "logs")
    level = F.get(F.array(*[F.lit(x) for x in ("DEBUG", "INFO ", "WARN ", "ERROR")]), (F.col("event_id") % 4).cast("int"))
    line = F.concat(
        level, F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" +"), "event_id", F.lit("ms service="), "event_type",
        F.lit(" user="), "user_id", F.lit(" said "), "event_type", F.lit(" twice"),
    )
    v.table("events").select(F.when(F.col("event_id") % 9 == 0, "garbage").otherwise(line).alias("value")).write.text(root)
    return logs.scan_logs(v.spark, root).select(
        "level", F.unix_seconds("ts").alias("second"), "elapsed_ms", F.col("tags.service").alias("service"), F.col("tags.user").alias("user"), "message"
    )


@query(
    "scan_corpus",
    """SELECT 'source=' || source || '/lang=' || lang AS folder, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines
       FROM documents WHERE starts_with(source, 'src1') AND lang <> 'de' GROUP BY 1""",
)
def _(v: Views):
    root = scratch_dir(v.spark, "corpus")
    v.table("documents").select("source", "lang", F.col("text").alias("value")).write.partitionBy("source", "lang").text(root)
    found = corpus.scan_corpus(v.spark, root, ("source=src1*/**/*.txt", "!**/lang=de/*"), max_depth=3)
    folder = F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)
    return found.groupBy(folder.alias("folder")).agg(F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"))
