"""Usage and billing ledger: pricing, charts, limits, balances.

Amounts are BIGINT micro-cents. Every per-key aggregate is a plain
``groupBy().agg()`` so that each task combines its own rows first; running
totals go through :func:`tidemark.operators.ordered.running`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import MICRO_PER_DOLLAR
from tidemark.functions.time import hour_bucket, hour_number, quota_status, retry_text, week_start
from tidemark.operators.ordered import running
from tidemark.session import checkpointed

TIER_TOKENS = 200_000
RELOAD_TRIGGER_DOLLARS = 5


def _or0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _wide(name: str) -> Column:
    """An amount whose sums may leave the range of BIGINT."""
    return F.col(name).cast("decimal(28,0)")


# -- filters and row-level columns ------------------------------------------


def pay_as_you_go() -> Column:
    """True for usage not covered by a plan. JSON without a plan gives null, so it is left out."""
    return F.col("enrichment").isNull() | (F.get_json_object("enrichment", "$.plan") != "sub")


def filter_payg_usage(usage: DataFrame) -> DataFrame:
    return usage.where(pay_as_you_go())


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.withColumns(
        {
            "total_input": F.col("input_tokens")
            + _or0("cache_read_tokens")
            + _or0("cache_write_5m_tokens")
            + _or0("cache_write_1h_tokens"),
            "total_output": F.col("output_tokens") + _or0("reasoning_tokens"),
        }
    )


# -- pricing -------------------------------------------------------------------


def price_usage(usage: DataFrame, prices: DataFrame, rule: str = "gateway", tier_tokens: int = TIER_TOKENS) -> DataFrame:
    """Add ``cost_nano`` (nano-dollars) and ``cost_micro`` (micro-cents).

    ``prices`` holds thousandths of a dollar per million tokens, joined on
    ``model``; a tier column without a price costs nothing. The gateway rule
    counts both cache writes towards the tier, the session rule does not.
    By the gateway rule a model without a price has null costs, by the session rule it costs nothing.
    """
    columns = set(prices.columns)
    tiered = F.col("p.tier_input").isNotNull()
    size = F.col("u.input_tokens") + F.coalesce("u.cache_read_tokens", F.lit(0))
    if rule == "gateway":
        size = size + F.coalesce("u.cache_write_5m_tokens", F.lit(0)) + F.coalesce("u.cache_write_1h_tokens", F.lit(0))
    elif rule != "session":
        raise ValueError(f"unknown pricing rule {rule}")
    tiered = tiered & (size > tier_tokens)

    def price(name: str) -> Column:
        base = F.col(f"p.{name}") if name in columns else F.lit(None).cast("long")
        tier = F.col(f"p.tier_{name}") if f"tier_{name}" in columns else F.lit(None).cast("long")
        return F.coalesce(F.when(tiered, tier).otherwise(base), F.lit(0))

    tokens = lambda name: F.coalesce(F.col(f"u.{name}"), F.lit(0))
    priced = F.lit(True) if rule == "session" else F.col("p.model").isNotNull()
    nano = (
        price("input") * tokens("input_tokens")
        + price("output") * (tokens("output_tokens") + tokens("reasoning_tokens"))
        + price("cache_read") * tokens("cache_read_tokens")
        + price("cache_write_5m") * tokens("cache_write_5m_tokens")
        + price("cache_write_1h") * tokens("cache_write_1h_tokens")
    )
    return (
        usage.alias("u")
        .join(prices.alias("p"), F.col("u.model") == F.col("p.model"), "left")
        .select("u.*", F.when(priced, nano).cast("long").alias("cost_nano"))
        .withColumn("cost_micro", F.floor((F.col("cost_nano") + 5) / 10).cast("long"))
    )


# -- charts ----------------------------------------------------------------------


def _in_month(month: str) -> Column:
    first = F.to_timestamp(F.lit(f"{month}-01"))
    return (F.col("ts") >= first) & (F.col("ts") < F.add_months(F.lit(f"{month}-01").cast("date"), 1).cast("timestamp"))


def cost_by_day(usage: DataFrame, month: str, by: tuple[str, ...] = ("model", "key_id")) -> DataFrame:
    """Pay-as-you-go cost per (UTC date, *by) in the month ``yyyy-mm``."""
    return (
        filter_payg_usage(usage)
        .where(_in_month(month))
        .groupBy(F.to_date("ts").alias("date"), *by)
        .agg(F.sum("cost").alias("total_cost"))
    )


def cost_grid(
    usage: DataFrame, month: str, models: list[str] | None = None, key_id: int | None = None
) -> DataFrame:
    """One row per day of the month and one column of dollars per model, zero where nothing was spent."""
    cost = cost_by_day(usage, month)
    if key_id is not None:
        cost = cost.where(F.col("key_id") == key_id)
    grid = cost.groupBy("date").pivot("model", models).agg(F.sum("total_cost"))
    first = F.to_date(F.lit(f"{month}-01"))
    days = usage.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("date"))
    dollars = [(F.coalesce(F.col(c), F.lit(0)) / F.lit(MICRO_PER_DOLLAR)).alias(c) for c in grid.columns if c != "date"]
    return days.join(grid, "date", "left").select("date", *dollars)


# -- usage per period --------------------------------------------------------------


def monthly_usage(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage.groupBy(*keys, F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(
        F.sum("cost").alias("monthly_usage"), F.max("ts").alias("updated")
    )


def running_monthly_usage(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly usage after each row; it restarts when the month changes."""
    rows = usage.withColumn("month", F.to_date(F.date_trunc("month", "ts")))
    return running(rows, [*keys, "month"], ["ts", "id"], {"monthly_usage": ("sum", F.col("cost"))})


def weekly_usage(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage.groupBy(*keys, F.to_date(week_start(F.col("ts"))).alias("week")).agg(
        F.sum("cost").alias("weekly_usage"), F.max("ts").alias("updated")
    )


def _window_chains(width: int, slots: int, keys: list[str]):
    """For one block of slots: every place a chain of windows can enter it or start, the chain inside, and where it leaves."""

    def chains(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        own_from, own_to = key[-1].as_py() * slots * width, (key[-1].as_py() + 1) * slots * width
        seconds = np.sort(rows.column("second").to_numpy())
        following = np.searchsorted(seconds, seconds + width, side="right")  # opens the next window, if this one opened one
        opens = np.concatenate([[True], np.diff(seconds) > width])[: len(seconds)]  # after such a gap, whatever was open is over
        first, last = np.searchsorted(seconds, [own_from, own_to])
        entered = np.unique(following[:first])
        entered = entered[(entered >= first) & (entered < last)]
        starts = np.union1d(entered, first + np.flatnonzero(opens[first:last]))
        chain, leaves = [], []
        for at in starts.tolist():
            here = []
            while at < last:
                here.append(int(seconds[at]))
                at = int(following[at])
                if at < len(seconds) and opens[at]:  # a start of its own
                    at = len(seconds)
            chain.append(here)
            leaves.append(int(seconds[at]) if at < len(seconds) else None)
        same = [pa.array([k.as_py()] * len(starts), k.type) for k in key[:-1]]
        found = [pa.array(seconds[starts]), pa.array(opens[starts]), pa.array(leaves, pa.int64()), pa.array(chain, pa.list_(pa.int64()))]
        return pa.table([*same, *found], names=[*keys, "node", "opens", "leaves", "chain"])

    return chains


def rolling_anchors(usage: DataFrame, keys: list[str], hours: int, slots: int = 64) -> DataFrame:
    """Opening second of every anchored window: (*keys, anchor).

    A window opens with the first event, takes in every event up to ``hours`` later,
    and the next event after that opens another. Only distinct seconds matter, and
    an event after a gap longer than the window always opens one. Between such gaps
    each second has a successor, the one whose window follows if its own opens one.

    Time is cut into blocks of ``slots`` slots as wide as the window. A task takes one
    block of one key (seconds in a bounded time, whatever the rows) and follows the
    successors from each second at which windows can start or come in from the block
    before, to where they leave. What is left is one hop per block; pointers are
    doubled until all hops from the starts are known.
    """
    width = hours * 3600
    seconds = usage.select(*keys, F.unix_seconds("ts").alias("second")).distinct()
    slot = F.floor(F.col("second") / width)
    inside = F.pmod(slot, F.lit(slots))
    # A block also sees two slots on either side: no successor that is not a start lies farther off.
    near = F.array(F.lit(0), F.when(inside < 2, -1).otherwise(0), F.when(inside >= slots - 2, 1).otherwise(0))
    rows = seconds.select(*keys, "second", F.floor(slot / slots).alias("block"), F.explode(F.array_distinct(near)).alias("more"))
    rows = rows.select(*keys, (F.col("block") + F.col("more")).alias("block"), "second")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in seconds.schema.fields[:-1]]
    schema = ", ".join([*fields, "node long, opens boolean, leaves long, chain array<long>"])
    found = checkpointed(rows.groupBy(*keys, "block").applyInArrow(_window_chains(width, slots, keys), schema))
    hops = found.where("leaves IS NOT NULL")
    reached = hops.where("opens").select(*keys, F.col("leaves").alias("node")).distinct()
    hops = hops.where("NOT opens").select(*keys, "node", "leaves")
    while not hops.isEmpty():
        further = reached.join(hops, [*keys, "node"]).select(*keys, F.col("leaves").alias("node"))
        reached = checkpointed(reached.unionByName(further).distinct())
        ends = hops.select(*keys, F.col("node").alias("leaves"), F.col("leaves").alias("_leaves"))
        hops = checkpointed(hops.join(ends, [*keys, "leaves"]).select(*keys, "node", F.col("_leaves").alias("leaves")))
    entered = found.where("NOT opens").join(reached, [*keys, "node"], "left_semi")
    return found.where("opens").unionByName(entered).select(*keys, F.explode("chain").alias("anchor"))


def rolling_usage(usage: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """Each row with the anchor of its window and the usage in the window so far.

    A slot as wide as the window holds at most one anchor, and a row belongs to
    the anchor of its own slot or of the one before: an equi-join finds it.
    """
    width = hours * 3600
    anchors = rolling_anchors(usage, keys, hours).withColumn("slot", F.floor(F.col("anchor") / width))
    per_slot = (
        anchors.select(*keys, "anchor", F.explode(F.array("slot", F.col("slot") + 1)).alias("_slot"), "slot")
        .groupBy(*keys, "_slot")
        .agg(
            F.max(F.when(F.col("slot") == F.col("_slot"), F.col("anchor"))).alias("_own"),
            F.max(F.when(F.col("slot") < F.col("_slot"), F.col("anchor"))).alias("_previous"),
        )
    )
    second = F.unix_seconds("ts")
    rows = (
        usage.withColumn("_slot", F.floor(second / width))
        .join(per_slot, [*keys, "_slot"])
        .withColumn("anchor", F.when(F.col("_own") <= second, F.col("_own")).otherwise(F.col("_previous")))
        .select(*usage.columns, "anchor")
    )
    return running(rows, [*keys, "anchor"], ["ts", "id"], {"rolling_usage": ("sum", F.col("cost"))})


def subscription_usage(usage: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """Current quota state per key: last week's total and last window's total, with their times."""
    fixed = (
        weekly_usage(usage, keys)
        .groupBy(*keys)
        .agg(
            F.max_by("weekly_usage", "week").alias("fixed_usage"),
            F.max("updated").alias("fixed_updated"),
        )
    )
    rolling = (
        rolling_usage(usage, keys, hours)
        .groupBy(*keys, "anchor")
        .agg(F.sum("cost").alias("used"))
        .groupBy(*keys)
        .agg(
            F.max_by("used", "anchor").alias("rolling_usage"),
            F.timestamp_seconds(F.max("anchor")).alias("rolling_updated"),
        )
    )
    return fixed.join(rolling, keys)


def hourly_ip_counts(usage: DataFrame) -> DataFrame:
    ip = F.when(F.col("ip") == "", "unknown").otherwise(F.col("ip"))
    return usage.groupBy(ip.alias("ip"), hour_bucket(F.col("ts")).alias("interval")).agg(F.count("*").alias("count"))


def trial_usage(usage: DataFrame, limits: dict[str | None, int]) -> DataFrame:
    """Tokens per ip counted towards a trial.

    ``limits`` maps a client to its limit, ``None`` to the default. A row counts
    while the sum so far is below the limit of its client. The limits are taken
    in rising order: below the lowest every row counts; from where it is
    reached, only rows with a higher limit do; and so on.
    """
    default = limits.get(None)
    limit = F.lit(default).cast("long")
    for client, value in limits.items():
        if client is not None:
            limit = F.when(F.col("model") == client, F.lit(value)).otherwise(limit)
    rows = usage_totals(usage).select(
        "ip", "ts", "id", (F.col("total_input") + F.col("total_output")).alias("tokens"), limit.alias("limit")
    )
    rows = rows.where((F.col("ip") != "") & (F.col("limit") > 0))
    counted = rows.select("ip", F.lit(0).cast("long").alias("used"), F.lit(None).cast("struct<ts:timestamp,id:bigint>").alias("at"))
    counted = counted.dropDuplicates(["ip"])
    for level in sorted({v for v in limits.values() if v}):
        here = F.struct("ts", "id")
        left = (
            rows.where(F.col("limit") >= level)
            .join(counted, "ip")
            .where((F.col("used") < level) & (F.col("at").isNull() | (here > F.col("at"))))
        )
        steps = running(left, ["ip"], ["ts", "id"], {"prior": ("sum", F.col("tokens"))}, inclusive=False).where(F.col("used") + F.coalesce("prior", F.lit(0)) < level)
        added = steps.groupBy("ip").agg(F.sum("tokens").alias("_more"), F.max(F.struct("ts", "id")).alias("_last"))
        counted = counted.join(added, "ip", "left").select(
            "ip",
            (F.col("used") + F.coalesce("_more", F.lit(0))).alias("used"),
            F.coalesce("_last", "at").alias("at"),
        )
    return counted.select("ip", F.col("used").alias("usage"))


# -- balances ----------------------------------------------------------------------


def ledger_entries(payments: DataFrame, usage: DataFrame, refunds: DataFrame) -> DataFrame:
    """One signed row per movement: (workspace_id, ts, kind, id, amount)."""
    paid = payments.select("workspace_id", "ts", F.lit("payment").alias("kind"), "id", "amount")
    used = filter_payg_usage(usage).select("workspace_id", "ts", F.lit("usage").alias("kind"), "id", (-F.col("cost")).alias("amount"))
    back = refunds.select(
        "workspace_id",
        F.timestamp_seconds("refunded").alias("ts"),
        F.lit("refund").alias("kind"),
        "id",
        (-F.col("amount")).alias("amount"),
    )
    return paid.unionByName(used).unionByName(back)


def grant_and_reload(
    billing: DataFrame, payments: DataFrame, usage: DataFrame, refunds: DataFrame, trigger: int = RELOAD_TRIGGER_DOLLARS
) -> DataFrame:
    """Balance after all movements, a DECIMAL(38, 0), and whether a top-up is due."""
    moved = ledger_entries(payments, usage, refunds).groupBy("workspace_id").agg(F.sum(_wide("amount")).alias("moved"))
    balance = (_wide("balance") + F.coalesce("moved", F.lit(0))).cast("decimal(38,0)")
    return billing.join(moved, "workspace_id", "left").select(
        "workspace_id",
        balance.alias("balance"),
        (F.col("reload") & (balance < trigger * MICRO_PER_DOLLAR)).alias("needs_reload"),
    )


def balance_history(entries: DataFrame) -> DataFrame:
    """Balance of the workspace after each movement, a DECIMAL(38, 0)."""
    totals = running(entries, ["workspace_id"], ["ts", "kind", "id"], {"balance": ("sum", _wide("amount"))})
    return totals.withColumn("balance", F.col("balance").cast("decimal(38,0)"))


def latest_payment_before(payments: DataFrame, anchors: Column) -> DataFrame:
    """For each payment where ``anchors`` holds: the newest earlier payment with a customer id."""
    rows = payments.withColumns({"_micros": F.unix_micros("ts"), "_anchor": anchors})
    candidate = F.when(F.col("customer_id").isNotNull(), F.struct("_micros", "id", "customer_id"))
    found = running(rows, ["workspace_id"], ["ts"], {"previous": ("max", candidate)}, strict_on="_micros")
    return found.where("_anchor").select(
        "workspace_id",
        "id",
        F.col("previous.id").alias("previous_id"),
        F.col("previous.customer_id").alias("previous_customer_id"),
    )


def apply_refunds(refunds: DataFrame, billing: DataFrame, payments: DataFrame) -> DataFrame:
    """Refunded payments: customer → workspace, then (workspace, payment id) → amount."""
    at = refunds.join(billing.select("customer_id", "workspace_id"), "customer_id").select(
        "workspace_id", F.col("payment_id").alias("id"), F.col("created").alias("refunded")
    )
    return payments.select("workspace_id", "id", "amount").join(at, ["workspace_id", "id"])


def refund_balances(refunded: DataFrame) -> DataFrame:
    return refunded.groupBy("workspace_id").agg((-F.sum("amount")).cast("long").alias("change"))


# -- limits ------------------------------------------------------------------------


def rate_limit_verdicts(requests: DataFrame, limit: int) -> DataFrame:
    """Requests of the same ip earlier in this clock hour and in the two before it."""
    rows = requests.withColumn("hour", hour_number(F.col("ts")))
    two_before = Window.partitionBy("ip").orderBy("hour").rangeBetween(-2, -1)
    # One row per (ip, hour): bounded by elapsed time.
    earlier_hours = (
        rows.groupBy("ip", "hour")
        .agg(F.count("*").alias("n"))
        .select("ip", "hour", F.coalesce(F.sum("n").over(two_before), F.lit(0)).alias("before"))
    )
    in_hour = running(rows, ["ip", "hour"], ["ts", "id"], {"earlier": ("count", F.lit(1))}, inclusive=False)
    prior = F.col("before") + F.col("earlier")
    return in_hour.join(earlier_hours, ["ip", "hour"]).select(
        *requests.columns, prior.alias("prior"), (prior >= limit).alias("limited")
    )


def spending_limits(
    requests: DataFrame,
    billing: DataFrame,
    users: DataFrame,
    subscriptions: DataFrame,
    own_providers: DataFrame,
    now: str,
    weekly_limit: int,
    rolling_limit: int,
    rolling_hours: int,
) -> DataFrame:
    """The first rule that stops each request, or ``ok``.

    ``billing`` and ``users`` carry ``monthly_usage`` / ``monthly_updated``,
    ``subscriptions`` the columns of :func:`subscription_usage`. Limits are in
    dollars.
    """
    at = F.to_timestamp(F.lit(now))
    same_month = lambda c: F.date_trunc("month", c) == F.date_trunc("month", at)
    quota = lambda usage, updated, limit, window: F.coalesce(
        (F.col(usage) > 0)
        & (
            quota_status(F.col(usage), F.col(updated), F.lit(limit * MICRO_PER_DOLLAR), at, window)["status"]
            == "rate-limited"
        ),
        F.lit(False),
    )
    over = lambda usage, updated, limit: F.coalesce(
        (F.col(limit) > 0) & (F.col(usage) > 0) & (F.col(usage) >= F.col(limit) * MICRO_PER_DOLLAR) & same_month(F.col(updated)),
        F.lit(False),
    )
    joined = (
        requests.join(
            billing.select(
                "workspace_id",
                "payment_method",
                "balance",
                F.col("monthly_limit").alias("w_limit"),
                F.col("monthly_usage").alias("w_usage"),
                F.col("monthly_updated").alias("w_updated"),
            ),
            "workspace_id",
        )
        .join(
            users.select(
                "workspace_id",
                "user_id",
                F.col("monthly_limit").alias("u_limit"),
                F.col("monthly_usage").alias("u_usage"),
                F.col("monthly_updated").alias("u_updated"),
            ),
            ["workspace_id", "user_id"],
        )
        .join(subscriptions, ["workspace_id", "user_id"], "left")
        .join(own_providers.select("workspace_id", "credentials"), "workspace_id", "left")
    )
    verdict = (
        F.when(F.col("credentials").isNotNull(), "ok")
        .when(
            F.col("subscription_id").isNotNull(),
            F.when(quota("fixed_usage", "fixed_updated", weekly_limit, None), "weekly limit")
            .when(quota("rolling_usage", "rolling_updated", rolling_limit, rolling_hours * 3600), "rolling limit")
            .otherwise("ok"),
        )
        .when(F.col("payment_method").isNull(), "no payment method")
        .when(F.col("balance") <= 0, "no balance")
        .when(over("w_usage", "w_updated", "w_limit"), "workspace limit")
        .when(over("u_usage", "u_updated", "u_limit"), "user limit")
        .otherwise("ok")
    )
    return joined.select(*requests.columns, verdict.alias("verdict"))


def account_summary(
    users: DataFrame,
    auth: DataFrame,
    subscriptions: DataFrame,
    now: str,
    weekly_limit: int,
    rolling_limit: int,
    rolling_hours: int,
) -> DataFrame:
    """Per user: email, spend against limit, quota use, whether limited, and for how long."""
    at = F.to_timestamp(F.lit(now))
    width = rolling_hours * 3600
    email = auth.where("provider = 'email'").select("account_id", F.col("subject").alias("email"))
    start = week_start(at)
    weekly = F.when(F.col("fixed_updated") >= start, F.col("fixed_usage")).otherwise(0)
    rolling = F.when(
        F.unix_micros("rolling_updated") >= F.unix_micros(at) - width * 1_000_000, F.col("rolling_usage")
    ).otherwise(0)
    week_limited = F.coalesce(weekly, F.lit(0)) >= weekly_limit * MICRO_PER_DOLLAR
    roll_limited = F.coalesce(rolling, F.lit(0)) >= rolling_limit * MICRO_PER_DOLLAR
    seconds = lambda ts: F.unix_micros(ts) / F.lit(1_000_000)
    week_wait = F.ceil(seconds(start) + 7 * 86400 - seconds(at))
    roll_wait = F.ceil(seconds(F.col("rolling_updated")) + width - seconds(at))
    subscribed = F.col("subscription_id").isNotNull()
    return (
        users.join(email, "account_id", "left")
        .join(subscriptions, ["workspace_id", "user_id"], "left")
        .select(
            "workspace_id",
            "user_id",
            "email",
            "role",
            F.coalesce("monthly_usage", F.lit(0)).alias("monthly_usage"),
            "monthly_limit",
            F.when(subscribed, F.coalesce(weekly, F.lit(0))).alias("weekly"),
            F.when(subscribed, F.coalesce(rolling, F.lit(0))).alias("rolling"),
            F.when(subscribed, week_limited | roll_limited).alias("limited"),
            F.when(subscribed & week_limited, retry_text(week_wait))
            .when(subscribed & roll_limited, retry_text(roll_wait))
            .alias("retry_in"),
        )
    )


# -- pages and lists -----------------------------------------------------------------


def usage_page(usage: DataFrame, page: int = 0, size: int = 50) -> DataFrame:
    return usage.orderBy(F.desc("ts"), F.desc("id")).offset(page * size).limit(size)


def payment_history(payments: DataFrame, n: int = 100) -> DataFrame:
    return payments.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
