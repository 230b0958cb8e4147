"""Domain views over the driver's tables, in Spark and as SQL for the oracle.

``Views(spark, dir)`` builds DataFrames; ``with_views(sql)`` puts the
views a query names in front of it as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import estimate_tokens
from tidemark.session import configure

NOW = "2024-01-20 12:00:00"
NOW_MS = 1705752000000
SESSION_EPOCH_MS = 1704067200000

# Prices per million tokens in thousandths of a dollar, so that
# tokens * price is a whole number of nano-dollars.
MODELS = [
    # provider, model, input, output, cache_read, cache_write, context, max_input, max_output
    ("north", "large", 3000, 15000, 300, 3750, 2000, None, 400),
    ("north", "small", 800, 4000, 80, 1000, 1000, 700, 128),
    ("south", "base", 2500, 10000, 1250, 0, 0, None, 100),
]

# Gateway prices per usage model: dollars per million tokens, in thousandths.
PRICES = [
    # model, input, output, cache_read, cache_write_5m, cache_write_1h, tier_input, tier_output, tier_cache_read
    ("click", 3000, 15000, 300, 3750, 6000, 6000, 22500, 600),
    ("error", 1250, 10000, 125, None, None, None, None, None),
    ("purchase", 500, 1500, None, None, None, None, None, None),
    ("signup", 600, 2500, 60, 75, 150, None, None, None),
    ("view", 2000, 12000, 200, None, None, 4000, 18000, 400),
]

# Ordered rules over a method-like permission and a url; the last match wins.
RULES = [
    ("*", "*", "ask"),
    ("read", "*", "allow"),
    ("read", "http://*", "ask"),
    ("read", "*/fr/*", "deny"),
    ("fetch", "https://*", "allow"),
    ("fetch", "*.example.org/*", "deny"),
    ("fetch", "*?page=2*", "allow"),
    ("f*", "https://m.*", "ask"),
    ("r??d", "*#top", "allow"),
    ("edit", "*", "deny"),
    ("edit", "*/de/* *", "allow"),
    ("*", "*/en/4??", "allow"),
]


def _values(rows: list[tuple]) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def u16(expr: str) -> str:
    """UTF-16 length in DuckDB."""
    return f"(length({expr}) + length(regexp_replace({expr}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def tok(expr: str) -> str:
    return f"(({u16(expr)} + 2) // 4)"


class Views:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = configure(spark)
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        # A pattern, as a stream takes no single file by its own path; it fits a folder of files as well.
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.path}/[{name[0]}]{name[1:]}.parquet")

    # -- usage ledger ------------------------------------------------------
    def usage(self, events: DataFrame | None = None) -> DataFrame:
        e = self.table("events") if events is None else events
        k = F.get_json_object("props", "$.k").cast("long")
        return e.select(
            F.col("event_id").alias("id"),
            F.col("ts").cast("timestamp").alias("ts"),
            (F.col("user_id") % 10).alias("workspace_id"),
            F.col("user_id").alias("key_id"),
            "user_id",
            F.col("event_type").alias("model"),
            F.concat(F.lit("10.0.0."), F.col("user_id") % 50).alias("ip"),
            (k * 100).alias("input_tokens"),
            (F.col("event_id") % 1000).alias("output_tokens"),
            F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50).alias("reasoning_tokens"),
            (F.col("event_id") % 7 * 10).alias("cache_read_tokens"),
            (F.col("event_id") % 11 * 5).alias("cache_write_5m_tokens"),
            F.lit(None).cast("long").alias("cache_write_1h_tokens"),
            (F.round(F.col("value") * 100).cast("long") * 1000000).alias("cost"),
            F.when(F.col("event_id") % 5 == 0, '{"plan":"sub"}')
            .when(F.col("event_id") % 50 == 1, "{}")
            .alias("enrichment"),
        )

    def event_log(self, events: DataFrame | None = None) -> DataFrame:
        e = self.table("events") if events is None else events
        return e.select(
            (F.col("user_id") % 20).alias("log_id"),
            F.floor(F.col("event_id") / 10).cast("long").alias("seq"),
            (F.col("event_id") % 10).alias("pos"),
            F.col("event_type").alias("kind"),
            F.concat("event_type", F.lit("/"), "user_id").alias("entity_key"),
            F.col("props").alias("data"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    def prices(self) -> DataFrame:
        return self.spark.createDataFrame(
            PRICES,
            "model string, input long, output long, cache_read long, cache_write_5m long, cache_write_1h long,"
            " tier_input long, tier_output long, tier_cache_read long",
        )

    # -- workspace star ----------------------------------------------------
    def workspaces(self) -> DataFrame:
        n = self.table("nation")
        return n.where("n_nationkey < 10").select(
            F.col("n_nationkey").cast("long").alias("workspace_id"),
            F.col("n_name").alias("workspace_name"),
            F.when(F.col("n_nationkey") == 8, F.lit(SESSION_EPOCH_MS)).alias("deleted_ms"),
        )

    def users(self) -> DataFrame:
        c = self.table("customer")
        key = F.col("c_custkey")
        return c.select(
            key.alias("user_id"),
            (key % 10).alias("workspace_id"),
            F.floor(key / 3).cast("long").alias("account_id"),
            F.col("c_name").alias("name"),
            F.when(key % 10 == 0, "admin").otherwise("member").alias("role"),
            (key * 7919 % 100003).alias("seen_minute"),
            F.when(key % 5 != 0, (key % 4 + 1) * 5).alias("monthly_limit"),
            F.when(key % 19 == 0, F.lit(SESSION_EPOCH_MS)).alias("deleted_ms"),
        )

    def auth(self) -> DataFrame:
        account = F.floor(F.col("c_custkey") / 3).cast("long")
        base = self.table("customer").where("c_custkey % 3 = 0").select(account.alias("account_id"), "c_name")
        email = base.where("account_id % 10 <> 0").select(
            "account_id", F.lit("email").alias("provider"), F.concat("c_name", F.lit("@x.test")).alias("subject")
        )
        other = base.select("account_id", F.lit("github").alias("provider"), F.col("c_name").alias("subject"))
        return email.unionByName(other)

    def keys(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("key_id"),
            (key % 10).alias("workspace_id"),
            key.alias("user_id"),
            F.concat(F.lit("key "), F.col("c_mktsegment")).alias("key_name"),
            F.concat(F.lit("sk-"), F.col("c_name")).alias("secret"),
            F.when(key % 13 == 0, F.lit(SESSION_EPOCH_MS)).alias("deleted_ms"),
        )

    def billing(self) -> DataFrame:
        c = self.table("customer")
        return (
            c.groupBy((F.col("c_custkey") % 10).alias("workspace_id"))
            .agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
            .select(
                "workspace_id",
                (F.col("cents") * 1000000).alias("balance"),
                F.when(F.col("workspace_id") != 3, F.concat(F.lit("pm_"), "workspace_id")).alias("payment_method"),
                F.lit(500).cast("long").alias("monthly_limit"),
                F.concat(F.lit("cus_w"), "workspace_id").alias("customer_id"),
                (F.col("workspace_id") % 2 == 0).alias("reload"),
            )
        )

    def subscriptions(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").where("c_custkey % 4 = 0").select(
            F.concat(F.lit("sub_"), key).alias("subscription_id"),
            (key % 10).alias("workspace_id"),
            key.alias("user_id"),
            F.when(key % 28 == 0, F.lit(SESSION_EPOCH_MS)).alias("deleted_ms"),
        )

    def own_providers(self) -> DataFrame:
        n = self.table("nation").where("n_nationkey = 7")
        return n.select(
            F.col("n_nationkey").cast("long").alias("workspace_id"),
            F.lit("north").alias("provider"),
            F.lit("own-secret").alias("credentials"),
        )

    def disabled_models(self) -> DataFrame:
        n = self.table("nation").where("n_nationkey < 10 AND n_nationkey % 2 = 0")
        return n.select(
            F.col("n_nationkey").cast("long").alias("workspace_id"),
            F.lit("error").alias("model"),
            F.when(F.col("n_nationkey") == 4, F.lit(SESSION_EPOCH_MS)).alias("deleted_ms"),
        )

    def payments(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("id"),
            (F.col("o_custkey") % 10).alias("workspace_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            (F.round(F.col("o_totalprice") * 100).cast("long") * 1000000).alias("amount"),
            F.when(F.col("o_orderstatus") == "F", "subscription")
            .when(F.col("o_orderstatus") == "P", "credit")
            .alias("type"),
            F.when(key % 9 != 0, F.concat(F.lit("cus_"), F.col("o_custkey"))).alias("customer_id"),
        )

    def refunds(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").where("o_orderkey % 31 = 0").select(
            F.concat(F.lit("cus_w"), F.col("o_custkey") % 10).alias("customer_id"),
            key.alias("payment_id"),
            (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 86400).alias("created"),
        )

    # -- sessions ----------------------------------------------------------
    def sessions(self) -> DataFrame:
        conv = self.table("conversations")
        title = F.max(F.when(F.col("turn") == 0, F.left("text", F.lit(40))))
        per = conv.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns"), title.alias("title"))
        created = F.lit(SESSION_EPOCH_MS) + F.col("id") * 3600000
        return per.select(
            "id",
            (F.col("id") % 5).alias("project_id"),
            F.concat(F.lit("/work/p"), F.col("id") % 5).alias("directory"),
            F.when((F.col("id") % 4 == 0) & (F.col("id") > 0), F.floor(F.col("id") / 4).cast("long")).alias("parent_id"),
            "title",
            created.alias("created"),
            (created + F.col("turns") * 60000).alias("updated"),
            F.when(F.col("id") % 17 == 0, created).alias("archived"),
        )

    def models(self) -> DataFrame:
        return self.spark.createDataFrame(
            MODELS,
            "provider_id string, model_id string, input_price long, output_price long, cache_read_price long,"
            " cache_write_price long, context_limit long, input_limit long, output_limit long",
        )

    def messages(self) -> DataFrame:
        conv = self.table("conversations")
        assistant = F.col("role") == "assistant"
        rows = conv.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("session_id"),
            "turn",
            F.when(assistant, "assistant").otherwise("user").alias("role"),
            "text",
            estimate_tokens(F.col("text")).alias("tokens"),
        )
        before = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.select(
            "*",
            F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("earlier"),
            F.max(F.when(F.col("role") == "user", F.col("id"))).over(before).alias("user_before"),
        )
        n = F.col("session_id") + F.col("turn")
        only = lambda c: F.when(assistant, c)
        inp, out = F.col("earlier"), F.col("tokens")
        reasoning, read = F.floor(F.col("tokens") / 5), F.floor(F.col("earlier") / 2)
        by_session = F.col("session_id") % 3
        pick = lambda i: F.when(by_session == 0, MODELS[0][i]).when(by_session == 1, MODELS[1][i]).otherwise(MODELS[2][i])
        cost = inp * pick(2) + out * pick(3) + reasoning * pick(3) + read * pick(4)
        created = F.lit(SESSION_EPOCH_MS) + F.col("session_id") * 3600000 + F.col("turn") * 60000
        return rows.select(
            "id",
            "session_id",
            "role",
            only(F.col("user_before")).alias("parent_id"),
            only(pick(0)).alias("provider_id"),
            only(pick(1)).alias("model_id"),
            only(inp).cast("long").alias("input_tokens"),
            only(out).cast("long").alias("output_tokens"),
            only(reasoning).cast("long").alias("reasoning_tokens"),
            only(read).cast("long").alias("cache_read_tokens"),
            only(F.lit(0)).cast("long").alias("cache_write_tokens"),
            only(cost).cast("long").alias("cost_nano"),
            (assistant & (n % 7 == 6)).alias("summary"),
            only(F.lit("stop")).alias("finish"),
            only(F.when(F.col("id") % 13 == 5, "MessageAbortedError").when(F.col("id") % 13 == 7, "APIError")).alias("error"),
            F.when(F.col("session_id") % 2 == 0, "build").otherwise("plan").alias("agent"),
            created.alias("created"),
            only(created + out * 100).alias("completed"),
        )

    def parts(self) -> DataFrame:
        conv = self.table("conversations")
        mid = (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id")
        summaries = conv.where("role = 'assistant' AND (conv_id + turn) % 7 = 6").select(
            (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("message_id"), F.lit(True).alias("before_summary")
        )
        lines = (
            conv.select(mid, F.col("conv_id").alias("session_id"), "role", F.split("text", "\n").alias("lines"))
            .join(summaries, "message_id", "left")
            .select(
                "message_id",
                "session_id",
                "role",
                F.coalesce("before_summary", F.lit(False)).alias("before_summary"),
                F.size("lines").alias("n_lines"),
                F.posexplode("lines").alias("line", "text"),
            )
        )
        line = F.col("line").cast("long")
        key = (F.col("message_id") + line) % 4
        kind = (
            F.when(F.col("role") != "assistant", F.when((line == 0) & F.col("before_summary"), "compaction").otherwise("text"))
            .when(line == 0, "step-start")
            .when(line == F.col("n_lines") - 1, "step-finish")
            .when((F.col("session_id") % 6 == 0) | (key == 1), "tool")
            .when(key == 0, "text")
            .when(key == 2, "reasoning")
            .otherwise("patch")
        )
        base = lines.select(
            (F.col("message_id") * 1000 + line).alias("id"), "message_id", "session_id", kind.alias("type"), "text", line.alias("line")
        )
        tool = F.col("type") == "tool"
        group = F.floor(F.col("line") / 4)
        failed = (F.col("message_id") + F.col("line")) % 11 == 0
        return base.select(
            "id",
            "message_id",
            "session_id",
            "type",
            F.when(F.col("type").isin("text", "reasoning"), F.col("text")).alias("text"),
            F.when(tool, F.concat(F.lit("tool"), (group % 3).cast("string"))).alias("tool"),
            F.when(tool, F.concat(F.lit('{"n":'), group.cast("string"), F.lit("}"))).alias("input"),
            F.when(tool, F.when(failed, "error").otherwise("completed")).alias("status"),
            F.when(tool & ~failed, F.repeat("text", 200)).alias("output"),
            F.when(tool & failed, F.col("text")).alias("error"),
            F.lit(None).cast("long").alias("compacted"),
            F.when(F.col("type").isin("step-start", "step-finish"), F.col("message_id").cast("string")).alias("snapshot"),
            F.when(F.col("type") == "patch", F.array(F.concat(F.lit("f"), (F.col("line") % 5).cast("string")))).alias("files"),
        )

    # -- corpus and project ------------------------------------------------
    def corpus(self) -> DataFrame:
        hidden = F.when(F.col("doc_id") % 29 == 0, ".").otherwise("")
        return self.table("documents").select(
            "doc_id",
            F.concat("source", F.lit("/"), "lang", F.lit("/"), hidden, "doc_id", F.lit(".txt")).alias("path"),
            F.col("doc_id").alias("mtime"),
            "text",
        )

    def pages(self) -> DataFrame:
        return self.table("pages").select(
            "page_id", "url", "html", F.when(F.col("page_id") % 2 == 0, "POST").otherwise("GET").alias("method")
        )

    def series(self) -> DataFrame:
        day = (
            self.table("orders")
            .groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(
                F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
                F.count_if(F.col("o_orderstatus") != "F").alias("n_other"),
            )
        )
        # One row per calendar day: bounded by the length of history.
        w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return day.select(
            "date",
            F.sum("n_f").over(w).alias("first"),
            F.sum("n_other").over(w).alias("second"),
            F.sum(F.col("n_f") + F.col("n_other")).over(w).alias("total"),
        )

    def commits(self) -> DataFrame:
        """One commit per order: author from the customer, title and files from the order."""
        key = F.col("o_orderkey")
        prefix = (
            F.when(key % 10 == 0, "chore: ").when(key % 10 == 1, "fix: ").when(key % 10 == 2, "feat: ").when(key % 10 == 3, "Test: ").otherwise("")
        )
        base = F.floor(key / 3).cast("string")
        title = F.concat(prefix, F.lit("change "), F.when(key % 3 == 2, F.floor(key / 3) + F.floor(key / 50) * 7).otherwise(F.floor(key / 3)).cast("string"))
        plain = F.concat(F.lit("change "), base)
        title = (
            F.when(key % 12 == 7, F.concat(F.lit('Revert "'), plain, F.lit('"')))
            .when(key % 12 == 8, F.concat(F.lit('Revert "Revert "'), plain, F.lit('""')))
            .otherwise(title)
        )
        return self.table("orders").select(
            F.lpad(F.hex(key), 12, "0").alias("hash"),
            key.alias("seq"),
            F.when(key % 17 != 0, F.concat(F.lit("dev"), F.col("o_custkey") % 40)).alias("author"),
            F.concat(title, F.lit("\nlonger body")).alias("message"),
            F.array(*[F.when((key + i) % 7 == m, p) for i, m, p in COMMIT_FILES]).alias("files_raw"),
        ).select("hash", "seq", "author", "message", F.filter("files_raw", lambda f: f.isNotNull()).alias("files"))


COMMIT_FILES = [
    (0, 0, "services/ingest/api/run.py"),
    (0, 1, "services/ingest/main.py"),
    (1, 3, "clients/desktop/lib.rs"),
    (2, 5, "clients/web/index.tsx"),
    (3, 6, "docs/guide/intro.md"),
    (4, 2, "README.md"),
]


_files_sql = ", ".join(f"CASE WHEN (o_orderkey + {i}) % 7 = {m} THEN '{p}' END" for i, m, p in COMMIT_FILES)


def _pick_sql(i: int) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE conv_id % 3 WHEN 0 THEN {lit(MODELS[0][i])} WHEN 1 THEN {lit(MODELS[1][i])} ELSE {lit(MODELS[2][i])} END"


VIEW_SQL: dict[str, str] = {
    "v_usage": """
        SELECT event_id AS id, ts, user_id % 10 AS workspace_id, user_id AS key_id, user_id, event_type AS model,
          '10.0.0.' || (user_id % 50) AS ip, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS input_tokens,
          event_id % 1000 AS output_tokens, CASE WHEN event_id % 3 <> 0 THEN event_id % 50 END AS reasoning_tokens,
          event_id % 7 * 10 AS cache_read_tokens, event_id % 11 * 5 AS cache_write_5m_tokens,
          CAST(NULL AS BIGINT) AS cache_write_1h_tokens, CAST(round(value * 100) AS BIGINT) * 1000000 AS cost,
          CASE WHEN event_id % 5 = 0 THEN '{"plan":"sub"}' WHEN event_id % 50 = 1 THEN '{}' END AS enrichment
        FROM events""",
    "v_log": """
        SELECT user_id % 20 AS log_id, event_id // 10 AS seq, event_id % 10 AS pos, event_type AS kind,
          event_type || '/' || user_id AS entity_key, props AS data, ts FROM events""",
    "v_prices": f"""
        SELECT * FROM (VALUES {_values(PRICES)}) t(model, input, output, cache_read, cache_write_5m, cache_write_1h,
          tier_input, tier_output, tier_cache_read)""",
    "v_workspaces": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS workspace_id, n_name AS workspace_name,
          CASE WHEN n_nationkey = 8 THEN {SESSION_EPOCH_MS} END AS deleted_ms FROM nation WHERE n_nationkey < 10""",
    "v_users": f"""
        SELECT c_custkey AS user_id, c_custkey % 10 AS workspace_id, c_custkey // 3 AS account_id, c_name AS name,
          CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'member' END AS role, c_custkey * 7919 % 100003 AS seen_minute,
          CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 4 + 1) * 5 END AS monthly_limit,
          CASE WHEN c_custkey % 19 = 0 THEN {SESSION_EPOCH_MS} END AS deleted_ms FROM customer""",
    "v_auth": """
        SELECT c_custkey // 3 AS account_id, 'email' AS provider, c_name || '@x.test' AS subject
        FROM customer WHERE c_custkey % 3 = 0 AND (c_custkey // 3) % 10 <> 0
        UNION ALL SELECT c_custkey // 3, 'github', c_name FROM customer WHERE c_custkey % 3 = 0""",
    "v_keys": f"""
        SELECT c_custkey AS key_id, c_custkey % 10 AS workspace_id, c_custkey AS user_id,
          'key ' || c_mktsegment AS key_name, 'sk-' || c_name AS secret,
          CASE WHEN c_custkey % 13 = 0 THEN {SESSION_EPOCH_MS} END AS deleted_ms FROM customer""",
    "v_billing": """
        SELECT workspace_id, cents * 1000000 AS balance,
          CASE WHEN workspace_id <> 3 THEN 'pm_' || workspace_id END AS payment_method,
          CAST(500 AS BIGINT) AS monthly_limit, 'cus_w' || workspace_id AS customer_id, workspace_id % 2 = 0 AS reload
        FROM (SELECT c_custkey % 10 AS workspace_id, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
              FROM customer GROUP BY 1)""",
    "v_subs": f"""
        SELECT 'sub_' || c_custkey AS subscription_id, c_custkey % 10 AS workspace_id, c_custkey AS user_id,
          CASE WHEN c_custkey % 28 = 0 THEN {SESSION_EPOCH_MS} END AS deleted_ms FROM customer WHERE c_custkey % 4 = 0""",
    "v_own": """
        SELECT CAST(n_nationkey AS BIGINT) AS workspace_id, 'north' AS provider, 'own-secret' AS credentials
        FROM nation WHERE n_nationkey = 7""",
    "v_disabled": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS workspace_id, 'error' AS model,
          CASE WHEN n_nationkey = 4 THEN {SESSION_EPOCH_MS} END AS deleted_ms
        FROM nation WHERE n_nationkey < 10 AND n_nationkey % 2 = 0""",
    "v_payments": """
        SELECT o_orderkey AS id, o_custkey % 10 AS workspace_id, o_orderdate AS ts,
          CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 AS amount,
          CASE o_orderstatus WHEN 'F' THEN 'subscription' WHEN 'P' THEN 'credit' END AS type,
          CASE WHEN o_orderkey % 9 <> 0 THEN 'cus_' || o_custkey END AS customer_id FROM orders""",
    "v_refunds": """
        SELECT 'cus_w' || (o_custkey % 10) AS customer_id, o_orderkey AS payment_id,
          epoch_us(o_orderdate) // 1000000 + 86400 AS created FROM orders WHERE o_orderkey % 31 = 0""",
    "v_sessions": f"""
        SELECT conv_id AS id, conv_id % 5 AS project_id, '/work/p' || (conv_id % 5) AS directory,
          CASE WHEN conv_id % 4 = 0 AND conv_id > 0 THEN conv_id // 4 END AS parent_id,
          max(CASE WHEN turn = 0 THEN left(text, 40) END) AS title,
          {SESSION_EPOCH_MS} + conv_id * 3600000 AS created,
          {SESSION_EPOCH_MS} + conv_id * 3600000 + count(*) * 60000 AS updated,
          CASE WHEN conv_id % 17 = 0 THEN {SESSION_EPOCH_MS} + conv_id * 3600000 END AS archived
        FROM conversations GROUP BY conv_id""",
    "v_models": f"""
        SELECT * FROM (VALUES {_values(MODELS)}) t(provider_id, model_id, input_price, output_price, cache_read_price,
          cache_write_price, context_limit, input_limit, output_limit)""",
    "v_messages": f"""
        SELECT id, session_id, CASE WHEN a THEN 'assistant' ELSE 'user' END AS role,
          CASE WHEN a THEN user_before END AS parent_id, CASE WHEN a THEN {_pick_sql(0)} END AS provider_id,
          CASE WHEN a THEN {_pick_sql(1)} END AS model_id, CASE WHEN a THEN earlier END AS input_tokens,
          CASE WHEN a THEN tokens END AS output_tokens, CASE WHEN a THEN tokens // 5 END AS reasoning_tokens,
          CASE WHEN a THEN earlier // 2 END AS cache_read_tokens, CASE WHEN a THEN CAST(0 AS BIGINT) END AS cache_write_tokens,
          CASE WHEN a THEN CAST(earlier * {_pick_sql(2)} + (tokens + tokens // 5) * {_pick_sql(3)}
            + (earlier // 2) * {_pick_sql(4)} AS BIGINT) END AS cost_nano,
          a AND (conv_id + turn) % 7 = 6 AS summary, CASE WHEN a THEN 'stop' END AS finish,
          CASE WHEN a AND id % 13 = 5 THEN 'MessageAbortedError' WHEN a AND id % 13 = 7 THEN 'APIError' END AS error,
          CASE WHEN conv_id % 2 = 0 THEN 'build' ELSE 'plan' END AS agent,
          {SESSION_EPOCH_MS} + conv_id * 3600000 + turn * 60000 AS created,
          CASE WHEN a THEN {SESSION_EPOCH_MS} + conv_id * 3600000 + turn * 60000 + tokens * 100 END AS completed
        FROM (SELECT *, CAST(coalesce(sum(tokens) OVER w, 0) AS BIGINT) AS earlier,
                max(CASE WHEN NOT a THEN id END) OVER w AS user_before
              FROM (SELECT *, conv_id * 1000 + turn AS id, conv_id AS session_id, role = 'assistant' AS a,
                      CAST({tok('text')} AS BIGINT) AS tokens FROM conversations)
              WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "v_parts": """
        SELECT id, message_id, session_id, type, CASE WHEN type IN ('text', 'reasoning') THEN txt END AS text,
          CASE WHEN type = 'tool' THEN 'tool' || (line // 4 % 3) END AS tool,
          CASE WHEN type = 'tool' THEN '{"n":' || (line // 4) || '}' END AS input,
          CASE WHEN type = 'tool' THEN CASE WHEN (message_id + line) % 11 = 0 THEN 'error' ELSE 'completed' END END AS status,
          CASE WHEN type = 'tool' AND (message_id + line) % 11 <> 0 THEN repeat(txt, 200) END AS output,
          CASE WHEN type = 'tool' AND (message_id + line) % 11 = 0 THEN txt END AS error,
          CAST(NULL AS BIGINT) AS compacted,
          CASE WHEN type IN ('step-start', 'step-finish') THEN CAST(message_id AS VARCHAR) END AS snapshot,
          CASE WHEN type = 'patch' THEN 'f' || (line % 5) END AS file
        FROM (SELECT message_id * 1000 + line AS id, message_id, session_id, txt, line,
                CASE WHEN role <> 'assistant' THEN CASE WHEN line = 0 AND before_summary THEN 'compaction' ELSE 'text' END
                     WHEN line = 0 THEN 'step-start' WHEN line = n_lines - 1 THEN 'step-finish'
                     WHEN session_id % 6 = 0 OR (message_id + line) % 4 = 1 THEN 'tool'
                     WHEN (message_id + line) % 4 = 0 THEN 'text' WHEN (message_id + line) % 4 = 2 THEN 'reasoning'
                     ELSE 'patch' END AS type
              FROM (SELECT c.conv_id * 1000 + c.turn AS message_id, c.conv_id AS session_id, c.role,
                      s.conv_id IS NOT NULL AS before_summary, len(string_split(c.text, chr(10))) AS n_lines,
                      unnest(string_split(c.text, chr(10))) AS txt,
                      CAST(unnest(range(len(string_split(c.text, chr(10))))) AS BIGINT) AS line
                    FROM conversations c LEFT JOIN conversations s
                      ON s.conv_id = c.conv_id AND s.turn = c.turn + 1 AND s.role = 'assistant'
                      AND (s.conv_id + s.turn) % 7 = 6))""",
    "v_corpus": """
        SELECT doc_id, source || '/' || lang || '/' || CASE WHEN doc_id % 29 = 0 THEN '.' ELSE '' END || doc_id || '.txt' AS path,
          doc_id AS mtime, text FROM documents""",
    "v_pages": """
        SELECT page_id, url, html, CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method FROM pages""",
    "v_series": """
        SELECT date, CAST(sum(n_f) OVER w AS BIGINT) AS first, CAST(sum(n_other) OVER w AS BIGINT) AS second,
          CAST(sum(n_f + n_other) OVER w AS BIGINT) AS total
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) FILTER (o_orderstatus = 'F') AS n_f,
                count(*) FILTER (o_orderstatus <> 'F') AS n_other FROM orders GROUP BY 1)
        WINDOW w AS (ORDER BY date)""",
    "v_commits": f"""
        SELECT lpad(upper(to_hex(o_orderkey)), 12, '0') AS hash, o_orderkey AS seq,
          CASE WHEN o_orderkey % 17 <> 0 THEN 'dev' || (o_custkey % 40) END AS author,
          CASE WHEN o_orderkey % 12 = 7 THEN 'Revert "change ' || (o_orderkey // 3) || '"'
               WHEN o_orderkey % 12 = 8 THEN 'Revert "Revert "change ' || (o_orderkey // 3) || '""'
               ELSE CASE o_orderkey % 10 WHEN 0 THEN 'chore: ' WHEN 1 THEN 'fix: ' WHEN 2 THEN 'feat: ' WHEN 3 THEN 'Test: '
                    ELSE '' END || 'change ' || (CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey // 3 + o_orderkey // 50 * 7
                    ELSE o_orderkey // 3 END) END || chr(10) || 'longer body' AS message,
          list_filter([{_files_sql}], lambda f: f IS NOT NULL) AS files
        FROM orders""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, dependencies first."""
    if sql.startswith("WITH RECURSIVE v_"):
        return sql
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEW_SQL and name not in needed:
                add(VIEW_SQL[name])
                needed.append(name)

    add(sql)
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in needed)
    body = sql.strip()
    if re.match(r"(?i)with\b", body):
        body = re.sub(r"(?i)^with\s+(recursive\s+)?", "", body)
        return f"WITH RECURSIVE {ctes},\n{body}" if ctes else f"WITH RECURSIVE {body}"
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
