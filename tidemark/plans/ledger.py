"""Queries over the usage ledger and the workspace star."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import money, time, usage as usage_functions
from tidemark.operators import ledger as L
from tidemark.operators import workspace as W
from tidemark.plans.registry import query
from tidemark.plans.views import NOW, PRICES, Views

MONTH = "2024-01"
HOURS = 5
WEEKLY_LIMIT = 100
ROLLING_LIMIT = 20
USER_MONTH = ["workspace_id", "user_id"]
PAYG = "(enrichment IS NULL OR json_extract_string(enrichment, '$.plan') <> 'sub')"
JANUARY = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"
TRIAL_LIMITS = {"click": 9000, None: 30000}


def micros(column: str):
    return F.unix_micros(column).alias(column)


# -- charts and totals ----------------------------------------------------------


@query(
    "cost_by_day",
    f"""SELECT workspace_id, CAST(ts AS DATE) AS date, model, key_id, CAST(sum(cost) AS BIGINT) AS total_cost
        FROM v_usage WHERE {JANUARY} AND {PAYG} GROUP BY ALL""",
)
def _(v: Views):
    return L.cost_by_day(v.usage(), MONTH, ("workspace_id", "model", "key_id"))


_GRID = ", ".join(
    f"coalesce(sum(cost) FILTER (model = '{p[0]}'), 0) / 100000000 AS {p[0]}" for p in PRICES
)


@query(
    "cost_grid",
    f"""SELECT d.date, {_GRID}
        FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date) d
        LEFT JOIN (SELECT * FROM v_usage WHERE {JANUARY} AND {PAYG}) u ON CAST(u.ts AS DATE) = d.date
        GROUP BY d.date""",
)
def _(v: Views):
    return L.cost_grid(v.usage(), MONTH, [p[0] for p in PRICES])


@query(
    "filter_payg_usage",
    f"SELECT id, cost, enrichment FROM v_usage WHERE {PAYG}",
)
def _(v: Views):
    return L.filter_payg_usage(v.usage()).select("id", "cost", "enrichment")


@query(
    "usage_totals",
    """SELECT id, input_tokens + coalesce(cache_read_tokens, 0) + coalesce(cache_write_5m_tokens, 0)
         + coalesce(cache_write_1h_tokens, 0) AS total_input,
         output_tokens + coalesce(reasoning_tokens, 0) AS total_output FROM v_usage""",
)
def _(v: Views):
    return L.usage_totals(v.usage()).select("id", "total_input", "total_output")


#: A model that is left out of the price list here, so that its usage has no price.
UNPRICED = "click"


def _listed(v: Views):
    return v.prices().where(F.col("model") != UNPRICED)


def _price_sql(size: str, threshold: int, unpriced: str) -> str:
    tier = f"p.tier_input IS NOT NULL AND {size} > {threshold}"
    write = "+ CASE WHEN t THEN 0 ELSE coalesce(cache_write_5m, 0) END * coalesce(cache_write_5m_tokens, 0)"
    return f"""
        SELECT id, nano AS cost_nano, (nano + 5) // 10 AS cost_micro FROM (
          SELECT id, CASE WHEN priced IS NULL THEN {unpriced} ELSE CAST(CASE WHEN t THEN tier_input ELSE input END * input_tokens
            + coalesce(CASE WHEN t THEN tier_output ELSE output END, 0) * (output_tokens + coalesce(reasoning_tokens, 0))
            + coalesce(CASE WHEN t THEN tier_cache_read ELSE cache_read END, 0) * cache_read_tokens {write} AS BIGINT) END AS nano
          FROM (SELECT u.*, p.* EXCLUDE (model), p.model AS priced, {tier} AS t FROM v_usage u
                LEFT JOIN (SELECT * FROM v_prices WHERE model <> '{UNPRICED}') p ON p.model = u.model))"""


@query(
    "price_usage",
    _price_sql("input_tokens + cache_read_tokens + cache_write_5m_tokens", 5000, "NULL"),
)
def _(v: Views):
    return L.price_usage(v.usage(), _listed(v), "gateway", 5000).select("id", "cost_nano", "cost_micro")


@query("price_usage_session", _price_sql("input_tokens + cache_read_tokens", 5000, "0"))
def _(v: Views):
    return L.price_usage(v.usage(), _listed(v), "session", 5000).select("id", "cost_nano", "cost_micro")


@query(
    "monthly_usage",
    f"""SELECT workspace_id, user_id, CAST(date_trunc('month', ts) AS DATE) AS month,
          CAST(sum(cost) AS BIGINT) AS monthly_usage, epoch_us(max(ts)) AS updated
        FROM v_usage WHERE {PAYG} GROUP BY 1, 2, 3""",
)
def _(v: Views):
    return L.monthly_usage(L.filter_payg_usage(v.usage()), USER_MONTH).withColumn("updated", F.unix_micros("updated"))


@query(
    "running_monthly_usage",
    f"""SELECT id, workspace_id, CAST(sum(cost) OVER (PARTITION BY workspace_id, date_trunc('month', ts) ORDER BY ts, id)
          AS BIGINT) AS monthly_usage FROM v_usage WHERE {PAYG}""",
)
def _(v: Views):
    return L.running_monthly_usage(L.filter_payg_usage(v.usage()), ["workspace_id"]).select(
        "id", "workspace_id", "monthly_usage"
    )


@query(
    "weekly_usage",
    """SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(sum(cost) AS BIGINT) AS weekly_usage,
         epoch_us(max(ts)) AS updated FROM v_usage GROUP BY 1, 2""",
)
def _(v: Views):
    return L.weekly_usage(v.usage(), ["user_id"]).withColumn("updated", F.unix_micros("updated"))


_ROLLING = f"""
    numbered AS (SELECT id, user_id, workspace_id, cost, epoch_us(ts) // 1000000 AS sec,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM v_usage),
    folded AS (
      SELECT id, user_id, workspace_id, n, sec AS anchor, cost AS rolling_usage FROM numbered WHERE n = 1
      UNION ALL
      SELECT x.id, x.user_id, x.workspace_id, x.n,
        CASE WHEN f.anchor >= x.sec - {HOURS * 3600} THEN f.anchor ELSE x.sec END,
        CASE WHEN f.anchor >= x.sec - {HOURS * 3600} THEN f.rolling_usage + x.cost ELSE x.cost END
      FROM folded f JOIN numbered x ON x.user_id = f.user_id AND x.n = f.n + 1)"""


@query("rolling_usage", f"WITH RECURSIVE {_ROLLING} SELECT id, user_id, anchor, rolling_usage FROM folded")
def _(v: Views):
    return L.rolling_usage(v.usage(), ["user_id"], HOURS).select("id", "user_id", "anchor", "rolling_usage")


@query(
    "hourly_ip_counts",
    "SELECT ip, strftime(ts, '%Y%m%d%H') AS interval, count(*) AS count FROM v_usage GROUP BY 1, 2",
)
def _(v: Views):
    return L.hourly_ip_counts(v.usage())


@query(
    "trial_usage",
    f"""WITH RECURSIVE numbered AS (
          SELECT ip, input_tokens + cache_read_tokens + cache_write_5m_tokens + output_tokens + coalesce(reasoning_tokens, 0) AS tokens,
            CASE WHEN model = 'click' THEN {TRIAL_LIMITS['click']} ELSE {TRIAL_LIMITS[None]} END AS lim,
            row_number() OVER (PARTITION BY ip ORDER BY ts, id) AS n FROM v_usage),
        folded AS (
          SELECT ip, n, tokens AS usage FROM numbered WHERE n = 1
          UNION ALL
          SELECT x.ip, x.n, CASE WHEN f.usage < x.lim THEN f.usage + x.tokens ELSE f.usage END
          FROM folded f JOIN numbered x ON x.ip = f.ip AND x.n = f.n + 1)
        SELECT ip, max(usage) AS usage FROM folded GROUP BY ip""",
)
def _(v: Views):
    return L.trial_usage(v.usage(), TRIAL_LIMITS)


# -- balances --------------------------------------------------------------------

_REFUNDED = """
    SELECT p.workspace_id, p.id, p.amount, r.created AS refunded
    FROM v_refunds r JOIN v_billing b USING (customer_id)
    JOIN v_payments p ON p.id = r.payment_id AND p.workspace_id = b.workspace_id"""
_ENTRIES = f"""
    SELECT workspace_id, ts, 'payment' AS kind, id, amount FROM v_payments
    UNION ALL SELECT workspace_id, ts, 'usage', id, -cost FROM v_usage WHERE {PAYG}
    UNION ALL SELECT workspace_id, make_timestamp(refunded * 1000000), 'refund', id, -amount FROM ({_REFUNDED})"""


def _refunded(v: Views):
    return L.apply_refunds(v.refunds(), v.billing(), v.payments())


@query("apply_refunds", _REFUNDED)
def _(v: Views):
    return _refunded(v)


@query(
    "refund_balances",
    f"SELECT workspace_id, CAST(-sum(amount) AS BIGINT) AS change FROM ({_REFUNDED}) GROUP BY 1",
)
def _(v: Views):
    return L.refund_balances(_refunded(v))


def _narrowed(df, column: str, largest):
    """``column`` as BIGINT, the type of the SQL, if ``largest`` (one row, one value) fits; a DECIMAL(38, 0) as it is if not."""
    most = largest.first()[0]
    return df.withColumn(column, F.col(column).cast("long")) if most is None or most < 1 << 63 else df


@query(
    "grant_and_reload",
    f"""SELECT workspace_id, bal AS balance, reload AND bal < 1000000000000000 AS needs_reload FROM (
          SELECT b.workspace_id, b.reload, CAST(b.balance + coalesce(sum(e.amount), 0) AS BIGINT) AS bal
          FROM v_billing b LEFT JOIN ({_ENTRIES}) e USING (workspace_id) GROUP BY b.workspace_id, b.reload, b.balance)""",
)
def _(v: Views):
    balances = L.grant_and_reload(v.billing(), v.payments(), v.usage(), _refunded(v), trigger=10_000_000)
    return _narrowed(balances, "balance", balances.agg(F.max(F.abs("balance"))))


@query(
    "balance_history",
    f"""SELECT workspace_id, kind, id, CAST(sum(amount) OVER (PARTITION BY workspace_id ORDER BY ts, kind, id) AS BIGINT)
          AS balance FROM ({_ENTRIES})""",
)
def _(v: Views):
    entries = L.ledger_entries(v.payments(), v.usage(), _refunded(v))
    # No balance is larger than the sum of its workspace's movements, signs left out.
    moved = entries.groupBy("workspace_id").agg(F.sum(F.abs("amount").cast("decimal(28,0)")).alias("n")).agg(F.max("n"))
    return _narrowed(L.balance_history(entries).select("workspace_id", "kind", "id", "balance"), "balance", moved)


@query(
    "latest_payment_before",
    """SELECT a.workspace_id, a.id, p.pid AS previous_id, p.cid AS previous_customer_id
       FROM (SELECT * FROM v_payments WHERE type = 'subscription') a
       ASOF LEFT JOIN (SELECT workspace_id, ts, max(id) AS pid, arg_max(customer_id, id) AS cid FROM v_payments
                       WHERE customer_id IS NOT NULL GROUP BY 1, 2) p
         ON a.workspace_id = p.workspace_id AND a.ts > p.ts""",
)
def _(v: Views):
    return L.latest_payment_before(v.payments(), F.col("type") == "subscription")


# -- limits ----------------------------------------------------------------------


@query(
    "rate_limit_verdicts",
    """SELECT id, ip, prior, prior >= 4 AS limited FROM (
         SELECT id, ip, count(*) OVER (PARTITION BY ip, h ORDER BY ts, id) - 1
           + coalesce((SELECT count(*) FROM v_usage o WHERE o.ip = u.ip AND epoch_us(o.ts) // 3600000000 BETWEEN u.h - 2 AND u.h - 1), 0) AS prior
         FROM (SELECT *, epoch_us(ts) // 3600000000 AS h FROM v_usage) u)""",
)
def _(v: Views):
    return L.rate_limit_verdicts(v.usage(), 4).select("id", "ip", "prior", "limited")


_SUBSCRIPTION_STATE = f"""
    {_ROLLING},
    fixed AS (
      SELECT workspace_id, user_id, arg_max(used, week) AS fixed_usage, max(updated) AS fixed_updated
      FROM (SELECT workspace_id, user_id, date_trunc('week', ts) AS week, CAST(sum(cost) AS BIGINT) AS used, max(ts) AS updated
            FROM v_usage GROUP BY 1, 2, 3) GROUP BY 1, 2),
    rolling AS (SELECT workspace_id, user_id, max(anchor) AS anchor, arg_max(rolling_usage, n) AS rolling_usage
                FROM folded GROUP BY 1, 2),
    state AS (
      SELECT s.subscription_id, s.workspace_id, s.user_id, f.fixed_usage, f.fixed_updated, r.rolling_usage, r.anchor
      FROM v_subs s LEFT JOIN fixed f USING (workspace_id, user_id) LEFT JOIN rolling r USING (workspace_id, user_id)
      WHERE s.deleted_ms IS NULL)"""


def _subscription_state(v: Views):
    state = L.subscription_usage(v.usage(), ["workspace_id", "user_id"], HOURS)
    plans = W.filter_live(v.subscriptions()).select("subscription_id", "workspace_id", "user_id")
    return plans.join(state, ["workspace_id", "user_id"], "left")


def _with_monthly(owners, usage, keys):
    latest = (
        L.monthly_usage(L.filter_payg_usage(usage), keys)
        .groupBy(*keys)
        .agg(F.max_by("monthly_usage", "month").alias("monthly_usage"), F.max("updated").alias("monthly_updated"))
    )
    return owners.join(latest, keys, "left")


@query(
    "subscription_usage",
    f"""WITH RECURSIVE {_SUBSCRIPTION_STATE}
        SELECT subscription_id, fixed_usage, epoch_us(fixed_updated) AS fixed_updated, rolling_usage, anchor
        FROM state WHERE anchor IS NOT NULL""",
)
def _(v: Views):
    return (
        _subscription_state(v)
        .where("rolling_usage IS NOT NULL")
        .select(
            "subscription_id",
            "fixed_usage",
            micros("fixed_updated"),
            "rolling_usage",
            F.unix_seconds("rolling_updated").alias("anchor"),
        )
    )


_AT = f"TIMESTAMP '{NOW}'"
_MONTHLY = lambda keys: f"""
    SELECT {keys}, arg_max(used, month) AS monthly_usage, max(updated) AS monthly_updated
    FROM (SELECT {keys}, date_trunc('month', ts) AS month, CAST(sum(cost) AS BIGINT) AS used, max(ts) AS updated
          FROM v_usage WHERE {PAYG} GROUP BY ALL) GROUP BY {keys}"""


@query(
    "spending_limits",
    f"""WITH RECURSIVE {_SUBSCRIPTION_STATE}
        SELECT k.key_id, k.workspace_id, k.user_id,
          CASE WHEN o.credentials IS NOT NULL THEN 'ok'
               WHEN s.subscription_id IS NOT NULL THEN
                 CASE WHEN s.fixed_usage > 0 AND s.fixed_updated >= date_trunc('week', {_AT}) AND s.fixed_usage >= {WEEKLY_LIMIT}00000000 THEN 'weekly limit'
                      WHEN s.rolling_usage > 0 AND s.anchor >= epoch_us({_AT}) // 1000000 - {HOURS * 3600} AND s.rolling_usage >= {ROLLING_LIMIT}00000000 THEN 'rolling limit'
                      ELSE 'ok' END
               WHEN b.payment_method IS NULL THEN 'no payment method' WHEN b.balance <= 0 THEN 'no balance'
               WHEN b.monthly_limit > 0 AND wm.monthly_usage >= b.monthly_limit * 100000000
                 AND date_trunc('month', wm.monthly_updated) = date_trunc('month', {_AT}) THEN 'workspace limit'
               WHEN u.monthly_limit > 0 AND um.monthly_usage >= u.monthly_limit * 100000000
                 AND date_trunc('month', um.monthly_updated) = date_trunc('month', {_AT}) THEN 'user limit'
               ELSE 'ok' END AS verdict
        FROM v_keys k JOIN v_billing b USING (workspace_id) JOIN v_users u USING (workspace_id, user_id)
        LEFT JOIN ({_MONTHLY('workspace_id')}) wm USING (workspace_id)
        LEFT JOIN ({_MONTHLY('workspace_id, user_id')}) um USING (workspace_id, user_id)
        LEFT JOIN state s USING (workspace_id, user_id) LEFT JOIN v_own o USING (workspace_id)
        WHERE k.deleted_ms IS NULL""",
)
def _(v: Views):
    usage = v.usage()
    return L.spending_limits(
        W.filter_live(v.keys()).select("key_id", "workspace_id", "user_id"),
        _with_monthly(v.billing(), usage, ["workspace_id"]),
        _with_monthly(v.users(), usage, ["workspace_id", "user_id"]),
        _subscription_state(v),
        v.own_providers(),
        NOW,
        WEEKLY_LIMIT,
        ROLLING_LIMIT,
        HOURS,
    )


_RETRY = lambda s: f"""
    CASE WHEN {s} // 86400 >= 1 THEN ({s} // 86400) || CASE WHEN {s} // 86400 > 1 THEN ' days' ELSE ' day' END
         WHEN {s} // 3600 >= 1 THEN ({s} // 3600) || 'hr ' || CAST(ceil(({s} % 3600) / 60) AS BIGINT) || 'min'
         ELSE CAST(ceil(({s} % 3600) / 60) AS BIGINT) || 'min' END"""
_WEEK_WAIT = f"(epoch_us(date_trunc('week', {_AT})) // 1000000 + 604800 - epoch_us({_AT}) // 1000000)"
_ROLL_WAIT = f"(anchor + {HOURS * 3600} - epoch_us({_AT}) // 1000000)"


@query(
    "account_summary",
    f"""WITH RECURSIVE {_SUBSCRIPTION_STATE},
        joined AS (
          SELECT u.workspace_id, u.user_id, a.subject AS email, u.role, coalesce(m.monthly_usage, 0) AS monthly_usage, u.monthly_limit,
            s.subscription_id, s.anchor,
            CASE WHEN s.fixed_updated >= date_trunc('week', {_AT}) THEN s.fixed_usage ELSE 0 END AS weekly,
            CASE WHEN s.anchor >= epoch_us({_AT}) // 1000000 - {HOURS * 3600} THEN s.rolling_usage ELSE 0 END AS rolling
          FROM v_users u LEFT JOIN v_auth a ON a.account_id = u.account_id AND a.provider = 'email'
          LEFT JOIN ({_MONTHLY('workspace_id, user_id')}) m ON m.workspace_id = u.workspace_id AND m.user_id = u.user_id
          LEFT JOIN state s ON s.workspace_id = u.workspace_id AND s.user_id = u.user_id)
        SELECT workspace_id, user_id, email, role, monthly_usage, monthly_limit,
          CASE WHEN subscription_id IS NOT NULL THEN weekly END AS weekly,
          CASE WHEN subscription_id IS NOT NULL THEN rolling END AS rolling,
          CASE WHEN subscription_id IS NOT NULL THEN weekly >= {WEEKLY_LIMIT}00000000 OR rolling >= {ROLLING_LIMIT}00000000 END AS limited,
          CASE WHEN subscription_id IS NULL THEN NULL WHEN weekly >= {WEEKLY_LIMIT}00000000 THEN {_RETRY(_WEEK_WAIT)}
               WHEN rolling >= {ROLLING_LIMIT}00000000 THEN {_RETRY(_ROLL_WAIT)} END AS retry_in
        FROM joined""",
)
def _(v: Views):
    return L.account_summary(
        _with_monthly(v.users(), v.usage(), ["workspace_id", "user_id"]),
        v.auth(),
        _subscription_state(v),
        NOW,
        WEEKLY_LIMIT,
        ROLLING_LIMIT,
        HOURS,
    )


# -- pages and lists -------------------------------------------------------------


@query("usage_page", "SELECT id, model, cost FROM v_usage ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100")
def _(v: Views):
    return L.usage_page(v.usage(), 2).select("id", "model", "cost")


@query("payment_history", "SELECT id, workspace_id, amount FROM v_payments ORDER BY ts DESC, id DESC LIMIT 100")
def _(v: Views):
    return L.payment_history(v.payments()).select("id", "workspace_id", "amount")


@query("distinct_models", "SELECT DISTINCT model FROM v_usage")
def _(v: Views):
    return L.distinct_values(v.usage(), "model")


# -- workspace star ----------------------------------------------------------------


@query(
    "resolve_credentials",
    """SELECT k.key_id, k.secret, k.workspace_id, w.workspace_name, k.user_id, b.balance, b.payment_method, u.monthly_limit,
         s.subscription_id, o.credentials, d.model IS NOT NULL AS is_disabled
       FROM v_keys k JOIN v_workspaces w USING (workspace_id) JOIN v_billing b USING (workspace_id)
       JOIN v_users u USING (workspace_id, user_id)
       LEFT JOIN v_disabled d ON d.workspace_id = k.workspace_id AND d.model = 'error' AND d.deleted_ms IS NULL
       LEFT JOIN v_own o ON o.workspace_id = k.workspace_id AND o.provider = 'north'
       LEFT JOIN v_subs s ON s.workspace_id = k.workspace_id AND s.user_id = k.user_id AND s.deleted_ms IS NULL
       WHERE k.deleted_ms IS NULL""",
)
def _(v: Views):
    return W.resolve_credentials(
        v.keys(), v.workspaces(), v.billing(), v.users(), v.disabled_models(), v.own_providers(), v.subscriptions(), "error", "north"
    )


_OWNED = """
    SELECT k.key_id, k.workspace_id, k.user_id, k.key_name, k.secret, a.subject AS email
    FROM v_keys k JOIN v_users u USING (workspace_id, user_id) JOIN v_auth a ON a.account_id = u.account_id AND a.provider = 'email'
    WHERE k.deleted_ms IS NULL"""


@query("keys_with_owner", _OWNED)
def _(v: Views):
    return W.keys_with_owner(v.keys(), v.users(), v.auth())


@query(
    "project_key_display",
    f"""SELECT key_id, left(secret, 7) || '...' || right(secret, 4) AS key_display,
          CASE WHEN user_id = 11 THEN secret END AS secret FROM ({_OWNED})""",
)
def _(v: Views):
    keys = W.keys_with_owner(v.keys(), v.users(), v.auth())
    return W.project_key_display(keys, 11).select("key_id", "key_display", "secret")


@query(
    "users_with_email",
    """SELECT u.user_id, u.workspace_id, a.subject AS email FROM v_users u
       LEFT JOIN v_auth a ON a.account_id = u.account_id AND a.provider = 'email' WHERE u.deleted_ms IS NULL""",
)
def _(v: Views):
    return W.users_with_email(v.users(), v.auth()).select("user_id", "workspace_id", "email")


@query("filter_live", "SELECT key_id, secret FROM v_keys WHERE deleted_ms IS NULL")
def _(v: Views):
    return W.filter_live(v.keys()).select("key_id", "secret")


@query(
    "keys_used_or_live",
    """SELECT k.workspace_id, k.key_id,
         a.subject || ' - ' || k.key_name || CASE WHEN k.deleted_ms IS NULL THEN '' ELSE ' (deleted)' END AS display_name
       FROM v_keys k JOIN v_users u USING (workspace_id, user_id) JOIN v_auth a ON a.account_id = u.account_id AND a.provider = 'email'
       WHERE k.deleted_ms IS NULL OR (k.workspace_id, k.key_id) IN (SELECT (workspace_id, key_id) FROM v_usage)""",
)
def _(v: Views):
    return W.keys_used_or_live(v.usage(), v.keys(), v.users(), v.auth())


@query(
    "account_workspaces",
    """SELECT u.account_id, u.user_id, u.workspace_id, w.workspace_name, u.role, s.subscription_id
       FROM v_users u RIGHT JOIN v_workspaces w ON u.workspace_id = w.workspace_id LEFT JOIN v_subs s ON s.user_id = u.user_id""",
)
def _(v: Views):
    return W.account_workspaces(v.users(), v.workspaces(), v.subscriptions())


@query(
    "available_models",
    """SELECT w.workspace_id, p.model FROM v_workspaces w, v_prices p WHERE NOT EXISTS (
         SELECT 1 FROM v_disabled d WHERE d.workspace_id = w.workspace_id AND d.model = p.model AND d.deleted_ms IS NULL)""",
)
def _(v: Views):
    return W.available_models(v.prices(), v.workspaces(), v.disabled_models())


@query(
    "last_seen_workspace",
    """SELECT account_id, arg_max(u.workspace_id, u.seen_minute * 10000000 + u.user_id) AS workspace_id
       FROM v_users u JOIN v_workspaces w ON w.workspace_id = u.workspace_id
       WHERE u.deleted_ms IS NULL AND w.deleted_ms IS NULL GROUP BY 1""",
)
def _(v: Views):
    return W.last_seen_workspace(v.users(), v.workspaces())


# -- scalar functions ----------------------------------------------------------------


@query("cents_to_micro", "SELECT event_id AS id, CAST(floor(value * 1000000 + 0.5) AS BIGINT) AS micro FROM events")
def _(v: Views):
    return v.table("events").select(F.col("event_id").alias("id"), money.cents_to_micro(F.col("value")).alias("micro"))


@query("micro_to_dollars", "SELECT id, cost / 100000000 AS dollars FROM v_usage")
def _(v: Views):
    return v.usage().select("id", money.micro_to_dollars(F.col("cost")).cast("double").alias("dollars"))


@query(
    "processing_fee",
    """SELECT id, CAST(floor((amount // 1000000 + 30) / 0.956::DOUBLE * 0.044::DOUBLE + 30 + 0.5) AS BIGINT) AS fee
       FROM v_payments""",
)
def _(v: Views):
    return v.payments().select("id", money.processing_fee(F.floor(F.col("amount") / 1000000)).alias("fee"))


@query("hour_bucket", "SELECT id, strftime(ts, '%Y%m%d%H') AS bucket FROM v_usage")
def _(v: Views):
    return v.usage().select("id", time.hour_bucket(F.col("ts")).alias("bucket"))


@query(
    "week_bounds",
    """SELECT id, CAST(date_trunc('week', ts) AS DATE) AS start, CAST(date_trunc('week', ts) + INTERVAL 7 DAY AS DATE) AS "end"
       FROM v_usage""",
)
def _(v: Views):
    week = time.week_bounds(F.col("ts"))
    return v.usage().select("id", F.to_date(week["start"]).alias("start"), F.to_date(week["end"]).alias("end"))


_ID = "'ses_' || lpad(lower(to_hex(((epoch_us(ts) // 1000 * 4096 + event_id % 4096) % 281474976710656)::BIGINT)), 12, '0') || 'abcdefghijklmn'"


@query(
    "id_timestamp",
    f"SELECT event_id AS id, {_ID} AS text_id, epoch_us(ts) // 1000 AS ms FROM events",
)
def _(v: Views):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    encoded = F.pmod(ms * 4096 + F.col("event_id") % 4096, F.lit(1 << 48))
    text = F.concat(F.lit("ses_"), F.lpad(F.lower(F.hex(encoded)), 12, "0"), F.lit("abcdefghijklmn"))
    ids = v.table("events").select(F.col("event_id").alias("id"), text.alias("text_id"))
    return ids.withColumn("ms", time.id_timestamp(F.col("text_id"), F.lit(1706832000000)))


@query(
    "quota_status",
    f"""SELECT id, CASE WHEN NOT stale AND cost >= 2000000000 THEN 'rate-limited' ELSE 'ok' END AS status,
          CASE WHEN stale THEN 86400 ELSE CAST(ceil((epoch_us(ts) / 1000000 + 86400) - epoch_us({_AT}) / 1000000) AS BIGINT) END AS reset_in_sec,
          CAST(CASE WHEN stale THEN 0 WHEN cost >= 2000000000 THEN 100 ELSE ceil(least(100.0, cost / 2000000000 * 100)) END AS BIGINT) AS usage_percent
        FROM (SELECT *, epoch_us(ts) / 1000000 < epoch_us({_AT}) / 1000000 - 86400 AS stale FROM v_usage)""",
)
def _(v: Views):
    status = time.quota_status(F.col("cost"), F.col("ts"), F.lit(2000000000), F.to_timestamp(F.lit(NOW)), 86400)
    return v.usage().select("id", status.alias("s")).select("id", "s.*")


_PAYLOAD = """
    CASE event_id % 4
      WHEN 0 THEN '{"input_tokens":' || k || ',"output_tokens":' || event_id % 1000 || ',"cache_read_input_tokens":' || event_id % 7
        || ',"cache_creation":{"ephemeral_5m_input_tokens":' || event_id % 5 || '}}'
      WHEN 1 THEN '{"input_tokens":' || k || ',"output_tokens":' || event_id % 1000
        || ',"output_tokens_details":{"reasoning_tokens":' || event_id % 9 || '},"input_tokens_details":{"cached_tokens":' || event_id % 3 || '}}'
      WHEN 2 THEN '{"prompt_tokens":' || k || ',"completion_tokens":' || event_id % 1000
        || CASE WHEN event_id % 8 = 2 THEN ',"cached_tokens":2' ELSE '' END || ',"prompt_tokens_details":{"cached_tokens":1}}'
      ELSE '{"promptTokenCount":' || k || ',"candidatesTokenCount":' || event_id % 1000 || ',"thoughtsTokenCount":' || event_id % 6 || '}'
    END"""
_WIRES = "element_at(array('anthropic', 'openai', 'oa-compat', 'google'), CAST(event_id % 4 AS INT) + 1)"


@query(
    "normalize_usage",
    """SELECT event_id AS id,
         CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k - event_id % 3 WHEN 2 THEN k - CASE WHEN event_id % 8 = 2 THEN 2 ELSE 1 END ELSE k END AS input_tokens,
         CASE event_id % 4 WHEN 1 THEN event_id % 1000 - event_id % 9 ELSE event_id % 1000 END AS output_tokens,
         CASE event_id % 4 WHEN 1 THEN event_id % 9 WHEN 3 THEN event_id % 6 END AS reasoning_tokens,
         CASE event_id % 4 WHEN 0 THEN event_id % 7 WHEN 1 THEN event_id % 3 WHEN 2 THEN CASE WHEN event_id % 8 = 2 THEN 2 ELSE 1 END ELSE 0 END AS cache_read_tokens,
         CASE event_id % 4 WHEN 0 THEN event_id % 5 END AS cache_write_5m_tokens,
         CAST(NULL AS BIGINT) AS cache_write_1h_tokens
       FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def _(v: Views):
    rows = v.table("events").withColumn("k", F.get_json_object("props", "$.k"))
    rows = rows.select(F.col("event_id").alias("id"), F.expr(_PAYLOAD).alias("payload"), F.expr(_WIRES).alias("wire"))
    return rows.select("id", usage_functions.normalize_usage(F.col("payload"), F.col("wire")).alias("n")).select("id", "n.*")


@query(
    "session_tokens",
    """SELECT id, CASE WHEN id % 2 = 0 THEN input_tokens ELSE input_tokens - cache_read_tokens END AS input,
         output_tokens AS output, coalesce(reasoning_tokens, 0) AS reasoning, cache_read_tokens AS cache_read,
         cache_write_5m_tokens AS cache_write FROM v_usage""",
)
def _(v: Views):
    tokens = usage_functions.session_tokens(
        F.col("input_tokens"),
        F.col("output_tokens"),
        F.col("reasoning_tokens"),
        F.col("cache_read_tokens"),
        F.col("cache_write_5m_tokens"),
        F.col("id") % 2 == 0,
    )
    return v.usage().select("id", tokens.alias("t")).select("id", "t.*")


@query(
    "pick_weighted",
    """SELECT event_id AS id, CASE WHEN h % 6 < 3 THEN 'a' WHEN h % 6 < 4 THEN 'b' ELSE 'c' END AS provider
       FROM (SELECT event_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(right('session-' || event_id, 4), ''),
               lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM events)""",
)
def _(v: Views):
    choices = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in (("a", 3), ("b", None), ("c", 2))]
    )
    session = F.concat(F.lit("session-"), "event_id")
    return v.table("events").select(
        F.col("event_id").alias("id"), usage_functions.pick_weighted(session, choices).alias("provider")
    )
