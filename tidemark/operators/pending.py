"""Permission requests still waiting for an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rules import matching_rules


def pending_requests(events: DataFrame, per_session: bool = False) -> DataFrame:
    """Requests without an answer: (session_id, id, permission).

    ``events`` are (session_id, seq, kind, id, permission, patterns, always,
    reply). A rejection also rejects what is open in its session. ``always``
    approves patterns and releases what is open in its session and now allowed;
    approvals count across sessions unless ``per_session``. A reply is taken to
    name a request that is open.
    """
    asked = events.where("kind = 'asked'").select("session_id", "seq", "id", "permission", "patterns", "always")
    replied = events.where("kind = 'replied'").select("session_id", F.col("seq").alias("at"), "id", "reply")
    unanswered = asked.join(replied.select("id"), "id", "left_anti")

    rejected = replied.where("reply = 'reject'").groupBy("session_id").agg(F.max("at").alias("_rejected"))
    waiting = unanswered.join(rejected, "session_id", "left").where("_rejected IS NULL OR _rejected < seq").drop("_rejected")

    always = replied.where("reply = 'always'")
    scope = ["session_id"] if per_session else []
    rules = (
        always.join(asked.select("id", "permission", "always"), "id")
        .select("session_id", "at", "permission", F.explode("always").alias("pattern"))
        .groupBy(*scope, "permission", "pattern")
        .agg(F.min("at").alias("idx"))
    )
    wanted = waiting.select("session_id", "id", "seq", "permission", F.explode_outer("patterns").alias("pattern"))
    renamed = rules.withColumnsRenamed({"permission": "rule_permission", "pattern": "rule_pattern"})
    matches = {"permission": "rule_permission", "pattern": "rule_pattern"}
    # With a scope the session is part of the join, so a request only meets rules of its own.
    asking = wanted.where("pattern IS NOT NULL")
    hits, open_rules = matching_rules(asking, renamed, matches, tuple(scope))
    on = ["permission", "pattern", *scope]
    earliest = hits.groupBy(*on).agg(F.min("idx").alias("_from"))
    wanted = wanted.join(earliest, on, "left")
    wanted = wanted.join(open_rules, scope, "left") if scope else wanted.join(F.broadcast(open_rules))  # one row without a scope
    own = lambda r: F.rlike(F.col("permission"), r["_re0"]) & F.rlike(F.col("pattern"), r["_re1"])
    always_open = F.array_min(F.transform(F.filter("_open", own), lambda r: r["idx"]))
    wanted = wanted.withColumn("_from", F.least("_from", always_open)).drop("_open")
    covered = (
        wanted.groupBy("session_id", "id", "seq")
        .agg(F.bool_and(F.col("pattern").isNull() | F.col("_from").isNotNull()).alias("_all"), F.max("_from").alias("_from"))
        .where("_all")
        .select("session_id", "id", "seq", F.greatest("seq", F.coalesce("_from", F.lit(-1))).alias("_from"))
    )
    # The last "always" of the session decides whether one came late enough.
    last = always.groupBy("session_id").agg(F.max("at").alias("_always"))
    released = covered.join(last, "session_id").where("_always >= _from AND _always > seq").select("id")
    return waiting.join(released, "id", "left_anti").select("session_id", "id", "permission")
