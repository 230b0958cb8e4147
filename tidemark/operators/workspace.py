"""Joins over the workspace star: keys, users, accounts, models.

No side is forced to be broadcast. Spark does that itself when the measured
size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import mask_secret


def live() -> Column:
    return F.col("deleted_ms").isNull()


def filter_live(df: DataFrame) -> DataFrame:
    """Rows that have not been soft-deleted."""
    return df.where(live())


def _emails(auth: DataFrame) -> DataFrame:
    return auth.where("provider = 'email'").select("account_id", F.col("subject").alias("email"))


def resolve_credentials(
    keys: DataFrame,
    workspaces: DataFrame,
    billing: DataFrame,
    users: DataFrame,
    disabled_models: DataFrame,
    own_providers: DataFrame,
    subscriptions: DataFrame,
    model: str,
    provider: str | None,
) -> DataFrame:
    """Every live key with its workspace, billing, user, plan and model state."""
    blocked = filter_live(disabled_models).where(F.col("model") == model).select("workspace_id", F.lit(True).alias("_off"))
    own = own_providers.where(F.col("provider") == provider).select("workspace_id", "credentials")
    plans = filter_live(subscriptions).select("workspace_id", "user_id", "subscription_id")
    return (
        filter_live(keys)
        .join(workspaces.select("workspace_id", "workspace_name"), "workspace_id")
        .join(billing.select("workspace_id", "balance", "payment_method"), "workspace_id")
        .join(users.select("workspace_id", "user_id", "monthly_limit"), ["workspace_id", "user_id"])
        .join(blocked, "workspace_id", "left")
        .join(own, "workspace_id", "left")
        .join(plans, ["workspace_id", "user_id"], "left")
        .select(
            "key_id",
            "secret",
            "workspace_id",
            "workspace_name",
            "user_id",
            "balance",
            "payment_method",
            "monthly_limit",
            "subscription_id",
            "credentials",
            F.coalesce("_off", F.lit(False)).alias("is_disabled"),
        )
    )


def keys_with_owner(keys: DataFrame, users: DataFrame, auth: DataFrame) -> DataFrame:
    return (
        filter_live(keys)
        .join(users.select("workspace_id", "user_id", "account_id"), ["workspace_id", "user_id"])
        .join(_emails(auth), "account_id")
        .select("key_id", "workspace_id", "user_id", "key_name", "secret", "email")
        .orderBy(F.desc("key_name"), "key_id")
    )


def project_key_display(keys: DataFrame, viewer: int) -> DataFrame:
    """Masked secret for all, the secret itself only for its owner."""
    return keys.withColumns(
        {
            "key_display": mask_secret(F.col("secret")),
            "secret": F.when(F.col("user_id") == viewer, F.col("secret")),
        }
    )


def users_with_email(users: DataFrame, auth: DataFrame) -> DataFrame:
    return filter_live(users).join(_emails(auth), "account_id", "left")


def keys_used_or_live(usage: DataFrame, keys: DataFrame, users: DataFrame, auth: DataFrame) -> DataFrame:
    used = usage.select("workspace_id", "key_id").distinct().withColumn("_used", F.lit(True))
    label = F.concat("email", F.lit(" - "), "key_name")
    return (
        keys.join(used, ["workspace_id", "key_id"], "left")
        .where(live() | F.col("_used"))
        .join(users.select("workspace_id", "user_id", "account_id"), ["workspace_id", "user_id"])
        .join(_emails(auth), "account_id")
        .select(
            "workspace_id",
            "key_id",
            F.when(live(), label).otherwise(F.concat(label, F.lit(" (deleted)"))).alias("display_name"),
        )
    )


def account_workspaces(users: DataFrame, workspaces: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """All workspaces with their users, kept when nobody is in them."""
    plans = subscriptions.select("user_id", "subscription_id")
    return (
        users.select("account_id", "user_id", "workspace_id", "role")
        .join(workspaces.select("workspace_id", "workspace_name"), "workspace_id", "right")
        .join(plans, "user_id", "left")
        .select("account_id", "user_id", "workspace_id", "workspace_name", "role", "subscription_id")
    )


def available_models(models: DataFrame, workspaces: DataFrame, disabled: DataFrame) -> DataFrame:
    """The catalogue per workspace without the models it has switched off.

    The catalogue is configuration: it becomes one row with one array. Its rows per
    workspace are the result itself; for a list of pairs see :func:`model_available`.
    """
    catalogue = models.agg(F.array_sort(F.collect_set("model")).alias("_offered"))
    off = filter_live(disabled).groupBy("workspace_id").agg(F.collect_set("model").alias("_off"))
    offered = workspaces.select("workspace_id").join(off, "workspace_id", "left").join(F.broadcast(catalogue))  # one row
    left = F.array_except("_offered", F.coalesce("_off", F.array().cast("array<string>")))
    return offered.select("workspace_id", F.explode(left).alias("model"))


def model_available(asked: DataFrame, models: DataFrame, disabled: DataFrame) -> DataFrame:
    """The (workspace_id, model) pairs of ``asked`` that are in the catalogue and not switched off."""
    known = asked.join(models.select("model").distinct(), "model", "left_semi")
    return known.join(filter_live(disabled).select("workspace_id", "model"), ["workspace_id", "model"], "left_anti")


def last_seen_workspace(users: DataFrame, workspaces: DataFrame) -> DataFrame:
    return (
        filter_live(users)
        .join(filter_live(workspaces).select("workspace_id"), "workspace_id")
        .groupBy("account_id")
        .agg(F.max_by("workspace_id", F.struct("seen_minute", "user_id")).alias("workspace_id"))
    )
