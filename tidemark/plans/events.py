"""Queries over event logs, metrics, commits, downloads and benchmark runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import errors
from tidemark.operators import eventlog as E
from tidemark.operators import project as P
from tidemark.plans.registry import query
from tidemark.plans.views import NOW_MS, Views
from tidemark.sources import documents as D

# -- logs ------------------------------------------------------------------------


@query(
    "scan_event_log",
    "SELECT log_id, seq, pos, entity_key FROM v_log WHERE log_id = 3 AND seq > 100 AND seq < 900 ORDER BY log_id, seq, pos LIMIT 200",
)
def _(v: Views):
    return E.scan_event_log(v.event_log(), 3, 100, 900, 200).select("log_id", "seq", "pos", "entity_key")


_COMPACT = """
    SELECT log_id, entity_key, arg_max(kind, seq * 10 + pos) AS kind, arg_max(data, seq * 10 + pos) AS data,
      max(seq * 10 + pos) // 10 AS seq, max(seq * 10 + pos) % 10 AS pos FROM v_log GROUP BY 1, 2"""


@query("compact_event_log", _COMPACT)
def _(v: Views):
    return E.compact_event_log(v.event_log())


@query("compact_event_log_incremental", _COMPACT)
def _(v: Views):
    log = v.event_log()
    return E.compact_event_log(log, E.compact_event_log(log.where("seq < 400")))


_PATHS = """
    paths AS (SELECT event_type || '/' || (user_id % 50) AS path, event_id % 100 AS frequency, epoch_us(ts) // 1000 AS last_open,
                event_id AS pos FROM events)"""


def path_log(v: Views):
    return v.table("events").select(
        F.concat("event_type", F.lit("/"), F.col("user_id") % 50).alias("path"),
        (F.col("event_id") % 100).alias("frequency"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("last_open"),
        F.col("event_id").alias("pos"),
    )


@query(
    "latest_by_key",
    f"""WITH {_PATHS} SELECT path, arg_max(frequency, pos) AS frequency, arg_max(last_open, pos) AS last_open
        FROM paths GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 100""",
)
def _(v: Views):
    return E.latest_by_key(path_log(v), 100)


@query(
    "frecency",
    f"""WITH {_PATHS} SELECT path, count(*) AS frequency, max(last_open) AS last_open,
          round(count(*) * (1 / (1 + ({NOW_MS + 20 * 86400000} - max(last_open)) / 86400000)), 9) AS score FROM paths GROUP BY 1""",
)
def _(v: Views):
    return E.frecency(path_log(v), NOW_MS + 20 * 86400000).withColumn("score", F.round("score", 9))


@query("tail_n", "SELECT log_id, seq, pos FROM v_log ORDER BY seq DESC, pos DESC LIMIT 50")
def _(v: Views):
    return E.tail_n(v.event_log(), 50).select("log_id", "seq", "pos")


@query(
    "log_gaps",
    """SELECT log_id, seq, pos, coalesce(ms - lag(ms) OVER (PARTITION BY log_id ORDER BY ts, seq, pos), 0) AS gap_ms
       FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM v_log)""",
)
def _(v: Views):
    return E.log_gaps(v.event_log(), ["log_id"]).select("log_id", "seq", "pos", "gap_ms")


# -- metrics ---------------------------------------------------------------------

_METRICS = """
    lines AS (SELECT event_id // 4 AS request_id, event_id % 4 AS pos, event_id % 5 AS k, user_id, event_type, json_extract_string(props, '$.k') AS n FROM events),
    fields AS (SELECT request_id, pos, 'user' AS key, CAST(user_id AS VARCHAR) AS value FROM lines WHERE k > 1
               UNION ALL SELECT request_id, pos, event_type, n FROM lines WHERE k > 1)"""


def metric_lines(v: Views):
    k = F.col("event_id") % 5
    message = (
        F.when(k == 0, "plain text")
        .when(k == 1, "_metric:not json")
        .otherwise(
            F.concat(
                F.lit('_metric:{"user":"'), "user_id", F.lit('","'), "event_type", F.lit('":"'), F.get_json_object("props", "$.k"), F.lit('"}')
            )
        )
    )
    return v.table("events").select(
        F.floor(F.col("event_id") / 4).cast("long").alias("request_id"), (F.col("event_id") % 4).alias("pos"), message.alias("message"), "event_type"
    )


def listed(metrics):
    return F.array_join(F.array_sort(F.transform(F.map_entries(metrics), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


@query(
    "merge_metrics",
    f"""WITH {_METRICS}, last AS (SELECT request_id, key, arg_max(value, pos) AS value FROM fields GROUP BY 1, 2)
        SELECT request_id, string_agg(key || '=' || value, ',' ORDER BY key || '=' || value) AS metrics FROM last GROUP BY 1""",
)
def _(v: Views):
    return E.merge_metrics(metric_lines(v)).withColumn("metrics", listed("metrics"))


@query(
    "trace_metrics",
    f"""WITH {_METRICS}, base AS (SELECT DISTINCT request_id, -1 AS pos, 'event_type' AS key, 'completions' AS value FROM lines
          UNION ALL SELECT DISTINCT request_id, -1, 'user', 'nobody' FROM lines),
        last AS (SELECT request_id, key, arg_max(value, pos) AS value FROM (SELECT * FROM fields UNION ALL SELECT * FROM base) GROUP BY 1, 2)
        SELECT request_id, string_agg(key || '=' || value, ',' ORDER BY key || '=' || value) AS metrics FROM last GROUP BY 1""",
)
def _(v: Views):
    # Four log lines per trace.
    traces = metric_lines(v).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "message"))).alias("l"))
    traces = traces.select("request_id", F.col("l.message").alias("logs"))
    merged = E.trace_metrics(traces, {"event_type": F.lit("completions"), "user": F.lit("nobody")})
    return merged.withColumn("metrics", listed("metrics"))


def chunks(v: Views, wire: str):
    e = v.table("events")
    seq = F.col("event_id") % 8
    if wire == "anthropic":
        start = F.concat(
            F.lit('event: message_start\ndata: {"message":{"usage":{"input_tokens":'), F.get_json_object("props", "$.k"),
            F.lit(',"cache_creation":{"ephemeral_5m_input_tokens":'), F.col("event_id") % 5, F.lit("}}}}"),
        )
        delta = F.concat(F.lit('event: message_delta\ndata: {"usage":{"output_tokens":'), F.col("event_id") % 1000, F.lit("}}"))
        chunk = F.when(seq == 0, start).when(F.col("event_id") % 3 == 0, delta).otherwise("event: ping\ndata: not json")
    else:
        usage = F.concat(
            F.lit('data: {"usage":{"prompt_tokens":'), F.get_json_object("props", "$.k"), F.lit(',"completion_tokens":'), F.col("event_id") % 1000, F.lit("}}")
        )
        chunk = F.when(F.col("event_id") % 3 == 0, usage).otherwise("data: [DONE]")
    return e.select(F.floor(F.col("event_id") / 8).cast("long").alias("request_id"), seq.alias("seq"), chunk.alias("chunk"), "ts")


@query(
    "merge_usage_deltas",
    """WITH c AS (SELECT event_id // 8 AS request_id, event_id, event_id % 8 AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
       SELECT request_id, coalesce(max(k) FILTER (seq = 0), 0) AS input_tokens,
         coalesce(arg_max(event_id % 1000, seq) FILTER (seq > 0 AND event_id % 3 = 0), 0) AS output_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens,
         CAST(NULL AS BIGINT) AS cache_read_tokens, max(event_id % 5) FILTER (seq = 0) AS cache_write_5m_tokens, CAST(NULL AS BIGINT) AS cache_write_1h_tokens
       FROM c WHERE seq = 0 OR event_id % 3 = 0 GROUP BY 1""",
)
def _(v: Views):
    return E.merge_usage_deltas(chunks(v, "anthropic"), "anthropic")


@query(
    "merge_usage_deltas_whole",
    """WITH c AS (SELECT event_id // 8 AS request_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 = 0)
       SELECT request_id, arg_max(k, event_id) AS input_tokens, arg_max(event_id % 1000, event_id) AS output_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens,
         CAST(NULL AS BIGINT) AS cache_read_tokens, CAST(NULL AS BIGINT) AS cache_write_5m_tokens, CAST(NULL AS BIGINT) AS cache_write_1h_tokens FROM c GROUP BY 1""",
)
def _(v: Views):
    return E.merge_usage_deltas(chunks(v, "oa-compat"), "oa-compat")


# -- errors ----------------------------------------------------------------------

_ERROR = """
    CASE event_id % 8
      WHEN 0 THEN '{"name":"APIError","data":{"isRetryable":true,"message":"Overloaded now"}}'
      WHEN 1 THEN '{"name":"APIError","data":{"isRetryable":false,"message":"no"}}'
      WHEN 2 THEN '{"name":"APIError","data":{"isRetryable":true,"message":"' || event_type || '"}}'
      WHEN 3 THEN '{"name":"X","data":{"message":"{\\\\"type\\\\":\\\\"error\\\\",\\\\"error\\\\":{\\\\"type\\\\":\\\\"too_many_requests\\\\"}}"}}'
      WHEN 4 THEN '{"name":"X","data":{"message":"{\\\\"code\\\\":\\\\"resource_exhausted\\\\"}"}}'
      WHEN 5 THEN '{"name":"X","data":{"message":"{\\\\"type\\\\":\\\\"error\\\\",\\\\"code\\\\":\\\\"x\\\\",\\\\"error\\\\":{\\\\"code\\\\":\\\\"rate_limit_y\\\\"}}"}}'
      WHEN 6 THEN '{"name":"X","data":{"message":"{\\\\"code\\\\":\\\\"x\\\\",\\\\"error\\\\":{\\\\"message\\\\":\\\\"boom\\\\"}}"}}'
      ELSE '{"name":"X","data":{"message":"plain ' || event_type || '"}}' END"""


@query(
    "classify_retryable",
    """SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'Provider is overloaded' WHEN 2 THEN event_type WHEN 3 THEN 'Too Many Requests'
         WHEN 4 THEN 'Provider is overloaded' WHEN 5 THEN 'Rate Limited' WHEN 6 THEN 'Provider Server Error' END AS reason FROM events""",
)
def _(v: Views):
    rows = v.table("events").select(F.col("event_id").alias("id"), F.expr(_ERROR).alias("error"))
    return rows.select("id", errors.classify_retryable(F.col("error")).alias("reason"))


@query(
    "error_message",
    """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN 'Too Many Requests' WHEN 2 THEN 'Unknown error' WHEN 3 THEN event_type
         WHEN 4 THEN 'Not Found: ' || event_type ELSE 'Not Found: ' || props END AS text FROM events""",
)
def _(v: Views):
    k = F.col("event_id") % 6
    status = F.when(k == 1, 429).when(k == 3, 500).when(k >= 4, 404)
    message = F.when(k <= 2, "").when(k == 3, F.col("event_type")).otherwise("Not Found")
    body = F.when(k == 4, F.concat(F.lit('{"message":"'), "event_type", F.lit('"}'))).when((k == 0) | (k == 5), F.col("props"))
    return v.table("events").select(F.col("event_id").alias("id"), errors.error_message(status, message, body).alias("text"))


# -- downloads -------------------------------------------------------------------

_ASSETS = """
    assets AS (SELECT 'v' || p_size AS tag, 'linux' AS asset, CAST(p_size AS BIGINT) * 10 AS downloads FROM part
      UNION ALL SELECT 'v' || p_size, 'mac', p_partkey % 100 FROM part)"""


def releases(v: Views):
    """One release document per part."""
    asset = lambda name, n: F.struct(F.lit(name).alias("name"), n.cast("long").alias("download_count"))
    doc = F.struct(
        F.concat(F.lit("v"), "p_size").alias("tag_name"),
        F.col("p_name").alias("name"),
        F.array(asset("linux", F.col("p_size") * 10), asset("mac", F.col("p_partkey") % 100)).alias("assets"),
    )
    return v.table("part").select(F.to_json(doc).alias("value"))


@query("scan_releases", f"WITH {_ASSETS} SELECT * FROM assets")
def _(v: Views):
    return D.scan_releases(releases(v))


@query("download_totals", f"WITH {_ASSETS} SELECT tag, CAST(sum(downloads) AS BIGINT) AS downloads FROM assets GROUP BY ROLLUP (tag)")
def _(v: Views):
    return P.download_totals(D.scan_releases(releases(v)))


@query("package_downloads", "SELECT event_type AS package, count(*) AS downloads FROM events GROUP BY 1")
def _(v: Views):
    days = v.table("events").groupBy(F.col("event_type").alias("package"), F.to_date("ts").alias("day")).agg(F.count("*").alias("downloads"))
    return P.package_downloads(days)


_DELTAS = ", ".join(f"{c}, {c} - coalesce(lag({c}) OVER (ORDER BY date), {c}) AS {c}_delta" for c in ("first", "second", "total"))


@query("download_deltas", f"SELECT date, {_DELTAS} FROM v_series")
def _(v: Views):
    return P.download_deltas(v.series().withColumn("row", F.lit(0))).drop("row")


# -- catalogue -------------------------------------------------------------------


def catalogue(v: Views):
    """One provider document per part."""
    cost = F.struct(
        F.col("p_retailprice").alias("input"), (F.col("p_retailprice") * 2).alias("output"), F.when(F.col("p_size") > 20, F.lit(0.5)).alias("cache_read")
    )
    model = F.struct(
        F.concat("p_type", F.lit("-"), "p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        cost.alias("cost"),
        F.struct((F.col("p_size") * 1000).alias("context"), (F.col("p_size") * 10).alias("output")).alias("limit"),
    )
    models = F.create_map(F.concat("p_type", F.lit("-"), "p_partkey"), model)
    provider = F.struct(F.col("p_brand").alias("id"), F.col("p_brand").alias("name"), models.alias("models"))
    return v.table("part").select(F.to_json(F.create_map("p_brand", provider)).alias("value"))


@query(
    "scan_model_catalogue",
    """SELECT p_brand AS provider_id, p_type || '-' || p_partkey AS model_id, p_name AS name, p_retailprice AS input_price, p_retailprice * 2 AS output_price,
         CASE WHEN p_size > 20 THEN CAST(0.5 AS DOUBLE) END AS cache_read_price, CAST(p_size AS BIGINT) * 1000 AS context_limit, CAST(p_size AS BIGINT) * 10 AS output_limit
       FROM part""",
)
def _(v: Views):
    return D.scan_model_catalogue(catalogue(v)).select(
        "provider_id", "model_id", "name", "input_price", "output_price", "cache_read_price", "context_limit", "output_limit"
    )


@query(
    "rank_models",
    """SELECT model_id, row_number() OVER (ORDER BY place DESC, latest, model_id DESC) AS rank FROM (
         SELECT model_id, CASE WHEN contains(model_id, 'ECONOMY') THEN 0 WHEN contains(model_id, 'SMALL') THEN 1 ELSE -1 END AS place,
           CASE WHEN contains(model_id, 'latest') THEN 0 ELSE 1 END AS latest
         FROM (SELECT p_type || '-' || p_partkey || CASE WHEN p_size % 10 = 0 THEN '-latest' ELSE '' END AS model_id FROM part))
       ORDER BY 2 LIMIT 500""",
)
def _(v: Views):
    models = v.table("part").select(
        F.concat("p_type", F.lit("-"), "p_partkey", F.when(F.col("p_size") % 10 == 0, "-latest").otherwise("")).alias("model_id")
    )
    top = D.rank_models(models, ("ECONOMY", "SMALL")).limit(500)
    # The list is cut to the 500 first, so one task numbers at most those.
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("place"), "latest", F.desc("model_id")))
    return top.select("model_id", rank.cast("long").alias("rank"))


# -- commits ---------------------------------------------------------------------

AREAS = (("services/ingest/api/", "api"), ("services/", "ingest"), ("clients/desktop/", "desktop"), ("clients/", "web"), ("docs/", "guide"))
SECTIONS = (("ingest", "Data"), ("api", "Interfaces"), ("web", "Clients"), ("desktop", "Clients"))
_AREA = """CASE WHEN f LIKE 'services/ingest/api/%' THEN 'api' WHEN f LIKE 'services/%' THEN 'ingest'
    WHEN f LIKE 'clients/desktop/%' THEN 'desktop' WHEN f LIKE 'clients/%' THEN 'web' WHEN f LIKE 'docs/%' THEN 'guide' END"""
_KEPT = f"""
    kept AS (SELECT left(hash, 7) AS hash, seq, author, title, areas FROM (
        SELECT *, string_split(message, chr(10))[1] AS title,
          list_sort(list_distinct(list_filter(list_transform(files, lambda f: {_AREA}), lambda a: a IS NOT NULL))) AS areas FROM v_commits)
      WHERE NOT regexp_matches(title, '(?i)^(ignore:|test:|chore:|ci:|release:)') AND len(areas) > 0)"""
_LEFT = f"""
    {_KEPT},
    deep AS (SELECT *, CAST(least(len(regexp_extract(title, '^((Revert ")*)', 1)) // 8, len(regexp_extract(title, '("*)$', 1))) AS INTEGER) AS depth FROM kept),
    based AS (SELECT *, substr(title, 8 * depth + 1, len(title) - 9 * depth) AS base FROM deep),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS n FROM based),
    folded AS (
      SELECT base, n, CASE depth WHEN 0 THEN seq END AS s0, CASE depth WHEN 1 THEN seq END AS s1, CASE depth WHEN 2 THEN seq END AS s2 FROM numbered WHERE n = 1
      UNION ALL
      SELECT x.base, x.n,
        CASE x.depth WHEN 0 THEN CASE WHEN f.s1 IS NULL THEN x.seq ELSE f.s0 END WHEN 1 THEN NULL ELSE f.s0 END,
        CASE x.depth WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN f.s0 IS NULL THEN x.seq ELSE f.s1 END ELSE NULL END,
        CASE x.depth WHEN 2 THEN CASE WHEN f.s1 IS NULL THEN x.seq ELSE f.s2 END ELSE f.s2 END
      FROM folded f JOIN numbered x ON x.base = f.base AND x.n = f.n + 1),
    ended AS (SELECT unnest([s0, s1, s2]) AS seq FROM (SELECT *, max(n) OVER (PARTITION BY base) AS last FROM folded) WHERE n = last),
    rest AS (SELECT k.* FROM kept k WHERE k.seq IN (SELECT seq FROM ended WHERE seq IS NOT NULL))"""


@query("filter_commits", f"WITH {_KEPT} SELECT hash, seq, author, title, array_to_string(areas, ',') AS areas FROM kept")
def _(v: Views):
    return P.filter_commits(v.commits(), AREAS).withColumn("areas", F.array_join("areas", ","))


@query(
    "commits_in_range",
    """SELECT hash, author, string_split(message, chr(10))[1] AS title FROM v_commits
       WHERE len(list_filter(files, lambda f: starts_with(f, 'docs/'))) > 0""",
)
def _(v: Views):
    commits = v.commits()
    hashes = commits.where(F.exists("files", lambda f: F.startswith(f, F.lit("docs/")))).select("hash")
    return P.commits_in_range(hashes, commits.drop("files")).select("hash", "author", "title")


@query("cancel_reverts", f"WITH RECURSIVE {_LEFT} SELECT seq, hash, title FROM rest")
def _(v: Views):
    return P.cancel_reverts(P.filter_commits(v.commits(), AREAS)).select("seq", "hash", "title")


@query(
    "changelog_sections",
    f"""WITH RECURSIVE {_LEFT},
        e AS (SELECT CASE WHEN list_contains(areas, 'ingest') THEN 'Data' WHEN list_contains(areas, 'api') THEN 'Interfaces'
                WHEN list_contains(areas, 'web') OR list_contains(areas, 'desktop') THEN 'Clients' ELSE 'Other' END AS section, seq,
                '- ' || title || CASE WHEN author IS NOT NULL AND author NOT IN ('dev1', 'dev2') THEN ' (@' || author || ')' ELSE '' END AS line FROM rest)
        SELECT section, seq, line FROM e UNION ALL SELECT DISTINCT section, NULL, '## ' || section FROM e""",
)
def _(v: Views):
    return P.changelog_sections(P.cancel_reverts(P.filter_commits(v.commits(), AREAS)), SECTIONS, ("dev1", "dev2"))


@query(
    "contributors",
    """SELECT DISTINCT author, string_split(message, chr(10))[1] AS title FROM v_commits
       WHERE author IS NOT NULL AND author NOT IN (SELECT 'dev' || (s_suppkey % 10) FROM supplier)
         AND NOT regexp_matches(message, '(?i)^(ignore:|test:|chore:|ci:|release:)')""",
)
def _(v: Views):
    team = v.table("supplier").select(F.concat(F.lit("dev"), F.col("s_suppkey") % 10).alias("author")).distinct()
    return P.contributors(v.commits(), team)


# -- benchmark -------------------------------------------------------------------

TASKS = [f"T{m:02d}" for m in range(1, 13)]


def runs(v: Views):
    """One benchmark run per customer with orders, one task per calendar month."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    month = v.table("orders").groupBy("o_custkey", F.concat(F.lit("T"), F.date_format("o_orderdate", "MM")).alias("task")).agg(
        F.sum(cents).alias("cents"), F.count("*").alias("n"), F.min(cents).alias("low"), F.max(cents).alias("high"), F.max("o_orderkey").alias("created")
    )
    score = lambda a, b: F.floor(a / b) / 100
    detail = lambda name, weight, c: F.struct(F.lit(name).alias("criterion"), F.lit(weight).alias("weight"), (F.col(c) / 100).alias("average"))
    task = F.struct(
        score(F.col("cents"), F.col("n")).alias("averageScore"),
        F.struct(F.col("task").alias("id")).alias("task"),
        F.array(
            F.struct(
                F.struct((F.col("high") / 100).alias("final")).alias("score"),
                F.array(detail("low", 1.0, "low"), detail("high", 2.0, "high")).alias("scoreDetails"),
            )
        ).alias("runs"),
    )
    # At most twelve tasks per run.
    per = month.groupBy("o_custkey").agg(
        F.collect_list(task).alias("tasks"), F.sum("cents").alias("cents"), F.sum("n").alias("n"), F.max("created").alias("created")
    )
    return per.select(
        F.col("o_custkey").alias("id"),
        F.when(F.col("o_custkey") % 2 == 0, "build").otherwise("plan").alias("agent"),
        F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"),
        "created",
        F.to_json(F.struct(score(F.col("cents"), F.col("n")).alias("averageScore"), "tasks")).alias("result"),
    )


_MONTHS = """
    m AS (SELECT o_custkey, 'T' || strftime(o_orderdate, '%m') AS task, CAST(sum(c) AS BIGINT) AS cents, count(*) AS n, min(c) AS low, max(c) AS high, max(o_orderkey) AS created
          FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) GROUP BY 1, 2)"""


@query(
    "benchmark_matrix",
    f"""WITH {_MONTHS}, r AS (SELECT o_custkey, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(n) AS BIGINT) AS n, max(created) AS created FROM m GROUP BY 1
                             ORDER BY created DESC, o_custkey DESC LIMIT 100)
        SELECT r.o_custkey AS id, CASE WHEN r.o_custkey % 2 = 0 THEN 'build' ELSE 'plan' END AS agent, 'm' || (r.o_custkey % 3) AS model,
          (r.cents // r.n) / 100 AS average, {", ".join(f"max((m.cents // m.n) / 100) FILTER (m.task = '{t}' AND r.o_custkey % 7 <> 0) AS {t}" for t in TASKS)}
        FROM r JOIN m USING (o_custkey) GROUP BY r.o_custkey, r.cents, r.n""",
)
def _(v: Views):
    # Every seventh run has no task.
    empty = F.when(F.col("id") % 7 == 0, F.regexp_replace("result", r'"tasks":\[.*\]', '"tasks":[]')).otherwise(F.col("result"))
    return P.benchmark_matrix(runs(v).withColumn("result", empty), TASKS)


@query(
    "benchmark_task",
    f"""WITH {_MONTHS}, t AS (SELECT * FROM m WHERE o_custkey = 0 AND task = 'T06')
        SELECT o_custkey AS id, (cents // n) / 100 AS average_score, 0 AS run, high / 100 AS final, 'low' AS criterion, CAST(1 AS DOUBLE) AS weight, low / 100 AS average FROM t
        UNION ALL SELECT o_custkey, (cents // n) / 100, 0, high / 100, 'high', 2, high / 100 FROM t""",
)
def _(v: Views):
    return P.benchmark_task(runs(v), 0, "T06")
