"""Operators over the messages and parts of a session.

A session may hold a large share of all rows, so nothing here opens a window
per session: cuts and barriers are ``max`` / ``min_by`` aggregates joined back,
and running sums use :func:`tidemark.operators.ordered.running`.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.text import estimate_tokens, utf16_length
from tidemark.operators.ordered import chunked_lists, joined_wide, partitions_for, running
from tidemark.session import checkpointed

# Fixed values.
OUTPUT_TOKEN_MAX = 32_000
PRUNE_PROTECT = 40_000
PRUNE_MINIMUM = 20_000
PRUNE_PROTECTED_TOOLS = ("skill",)
TURNS_PROTECTED = 2
COMPACTION_PROMPT = "What did we do so far?"
SUBTASK_PROMPT = "The following tool was executed by the user"
CLEARED_OUTPUT = "[Old tool result content cleared]"
INTERRUPTED = "[Tool execution was interrupted]"


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# -- transcripts -------------------------------------------------------------------


def project_model_messages(
    messages: DataFrame, parts: DataFrame, size: int = 1000
) -> DataFrame:
    """Transcript as model input: (session_id, message_id, role, chunk, parts).

    Ignored text and plain-text files are left out, cleared outputs replaced,
    unfinished calls turned into errors, failed replies and replies made of
    step marks only dropped.
    """
    kind, status = F.col("type"), F.col("status")
    ignored = F.coalesce(_optional(parts, "ignored", "boolean"), F.lit(False))
    rows = parts.select(
        "message_id",
        "id",
        "type",
        "text",
        "tool",
        "input",
        "status",
        "output",
        F.col("error").alias("tool_error"),
        "compacted",
        ignored.alias("ignored"),
        _optional(parts, "mime").alias("mime"),
        _optional(parts, "url").alias("url"),
    )
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    plain = F.coalesce(F.col("mime").isin("text/plain", "application/x-directory"), F.lit(False))
    state = F.when(status == "completed", "output-available").otherwise("output-error")
    result = (
        F.when(status == "completed", F.when(F.col("compacted").isNotNull(), CLEARED_OUTPUT).otherwise(F.col("output")))
        .when(status == "error", F.col("tool_error"))
        .otherwise(INTERRUPTED)
    )
    # What is kept, under which type, and its text; null types fall away.
    cases = [
        (user & (kind == "text") & ~F.col("ignored"), F.lit("text"), F.col("text")),
        (user & (kind == "file") & ~plain, F.lit("file"), F.col("url")),
        (user & (kind == "compaction"), F.lit("text"), F.lit(COMPACTION_PROMPT)),
        (user & (kind == "subtask"), F.lit("text"), F.lit(SUBTASK_PROMPT)),
        (assistant & kind.isin("text", "reasoning"), kind, F.col("text")),
        (assistant & (kind == "step-start"), kind, F.lit(None).cast("string")),
        (assistant & (kind == "tool"), F.lit("tool"), result),
    ]

    def first(values: list[Column]) -> Column:
        found = F.when(cases[0][0], values[0])
        for (condition, *_), value in zip(cases[1:], values[1:]):
            found = found.when(condition, value)
        return found

    known = messages.select(F.col("id").alias("message_id"), "session_id", "role", F.col("error").alias("message_error"))
    # Decided on narrow rows; the texts go to the messages that stay.
    marks = rows.select("message_id", "type", "ignored", "mime").join(known.select("message_id", "role"), "message_id")
    marks = marks.withColumn("_type", first([c[1] for c in cases]))
    useful = marks.groupBy("message_id").agg(
        F.bool_or(~kind.isin("step-start", "reasoning")).alias("_progress"),
        F.bool_or(F.col("_type").isNotNull() & (F.col("_type") != "step-start")).alias("_content"),
    )
    aborted = F.col("message_error") == "MessageAbortedError"
    failed = assistant & F.col("message_error").isNotNull() & ~(aborted & F.col("_progress"))
    staying = known.join(useful, "message_id").where(F.col("_content") & ~failed).select("message_id", "session_id", "role")
    partitions = partitions_for(rows)
    called = assistant & (kind == "tool")
    part = F.struct(
        F.when(called, F.concat(F.lit("tool-"), "tool")).otherwise(F.col("_type")).alias("type"),
        F.when(called, state).alias("state"),
        F.when(called, F.col("input")).alias("input"),
        first([c[2] for c in cases]).alias("text"),
    )
    wanted = joined_wide(rows, staying, "message_id", ["id"], partitions).withColumn("_type", first([c[1] for c in cases]))
    return chunked_lists(
        wanted.where(F.col("_type").isNotNull()).select("session_id", "message_id", "role", "id", part.alias("part")),
        ["session_id", "message_id", "role"],
        ["id"],
        ["part"],
        size,
        "parts",
        partitions,
    ).withColumn("parts", F.col("parts.part"))


@F.pandas_udf(StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON text indented by two spaces; text that is not JSON as it is."""

    def pretty(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except ValueError:
            return t

    return text.map(pretty)


def render_transcripts(
    sessions: DataFrame,
    messages: DataFrame,
    parts: DataFrame,
    thinking: bool = True,
    tool_details: bool = True,
    assistant_metadata: bool = True,
    size: int = 2000,
) -> DataFrame:
    """Markdown per session as (session_id, chunk, text); the chunks follow one another."""
    when = lambda c: F.date_format(F.timestamp_millis(F.col(c)), "M/d/yyyy, h:mm:ss a")
    position = ["message_id", "step", "part_id"]
    none = F.lit(None).cast("long")
    head = sessions.select(
        F.col("id").alias("session_id"),
        none.alias("message_id"),
        F.lit(0).alias("step"),
        none.alias("part_id"),
        F.concat(
            F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n**Session ID:** "), F.col("id").cast("string"),
            F.lit("\n**Created:** "), when("created"), F.lit("\n**Updated:** "), when("updated"), F.lit("\n\n---\n\n"),
        ).alias("text"),
    )
    seconds = F.format_string("%.1fs", (F.col("completed") - F.col("created")) / 1000)
    detail = F.concat(
        F.lit("## Assistant ("), F.initcap("agent"), F.lit(" · "), "model_id",
        F.coalesce(F.concat(F.lit(" · "), seconds), F.lit("")), F.lit(")\n\n"),
    )
    heading = F.when(F.col("role") == "user", "## User\n\n").otherwise(
        detail if assistant_metadata else F.lit("## Assistant\n\n")
    )
    mark = lambda step, text: messages.select(
        "session_id", F.col("id").alias("message_id"), F.lit(step).alias("step"), none.alias("part_id"), text.alias("text")
    )
    fence = lambda title, body, lang="": F.coalesce(
        F.concat(F.lit(f"\n**{title}:**\n```{lang}\n"), body, F.lit("\n```")), F.lit("")
    )
    status = F.col("status")
    call = [F.lit("```\nTool: "), F.col("tool"), F.lit("\n")]
    if tool_details:
        call += [
            fence("Input", pretty_json(F.when(F.col("type") == "tool", F.col("input"))), "json"),
            fence("Output", F.when((status == "completed") & (F.col("output") != ""), F.col("output"))),
            fence("Error", F.when((status == "error") & (F.col("error") != ""), F.col("error"))),
        ]
    call.append(F.lit("\n```\n\n"))
    synthetic = F.coalesce(_optional(parts, "synthetic", "boolean"), F.lit(False))
    body = F.when((F.col("type") == "text") & ~synthetic, F.concat("text", F.lit("\n\n"))).when(
        F.col("type") == "tool", F.concat(*call)
    )
    if thinking:
        body = body.when(F.col("type") == "reasoning", F.concat(F.lit("_Thinking:_\n\n"), "text", F.lit("\n\n")))
    lines = parts.select(
        "session_id", "message_id", F.lit(1).alias("step"), F.col("id").alias("part_id"), body.alias("text")
    ).where(F.col("text").isNotNull())
    pieces = head.unionByName(mark(0, heading)).unionByName(lines).unionByName(mark(2, F.lit("---\n\n")))
    lists = chunked_lists(pieces, ["session_id"], position, ["text"], size, "pieces", partitions_for(parts))
    return lists.select("session_id", "chunk", F.array_join("pieces.text", "").alias("text"))


def turns(messages: DataFrame) -> DataFrame:
    """Each user message with its replies up to the next user message."""
    users = running(
        messages.where("role = 'user'").select("session_id", "id", "created"),
        ["session_id"],
        ["id"],
        {"next_id": ("min", F.col("id"))},
        inclusive=False,
        descending=True,
    )
    replies = messages.where("role = 'assistant'").select(
        "session_id", F.col("parent_id").alias("_parent"), F.col("id").alias("reply_id"), "completed", "error"
    )
    in_turn = (F.col("reply_id") > F.col("id")) & (F.col("next_id").isNull() | (F.col("reply_id") < F.col("next_id")))
    joined = users.join(
        replies.withColumnRenamed("_parent", "id"), ["session_id", "id"], "left"
    ).where(F.col("reply_id").isNull() | in_turn)
    answered = joined.groupBy("session_id", "id").agg(
        F.count("reply_id").alias("replies"),
        F.max("reply_id").alias("last_reply"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("reply_id"))).alias("first_error"),
        (F.max_by("completed", "reply_id") - F.max("created")).alias("duration_ms"),
    )
    return users.select("session_id", "id").join(answered, ["session_id", "id"], "left").withColumn(
        "replies", F.coalesce("replies", F.lit(0))
    )


# -- context -----------------------------------------------------------------------


def active_context(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages from the newest completed compaction on; all of them where there is none."""
    asked = parts.where("type = 'compaction'").select("session_id", F.col("message_id").alias("id")).distinct()
    finished = messages.where("role = 'assistant' AND summary AND finish IS NOT NULL").select(
        "session_id", F.col("parent_id").alias("id"), F.col("id").alias("_done")
    )
    cut = (
        messages.where("role = 'user'")
        .select("session_id", "id")
        .join(asked, ["session_id", "id"], "left_semi")
        .join(finished, ["session_id", "id"])
        .where("_done > id")
        .groupBy("session_id")
        .agg(F.max("id").alias("_cut"))
    )
    return messages.join(cut, "session_id", "left").where(F.col("_cut").isNull() | (F.col("id") >= F.col("_cut"))).drop("_cut")


def prune_tool_outputs(
    messages: DataFrame,
    parts: DataFrame,
    protect: int = PRUNE_PROTECT,
    minimum: int = PRUNE_MINIMUM,
    protected_tools: tuple[str, ...] = PRUNE_PROTECTED_TOOLS,
) -> DataFrame:
    """Tool parts whose output can be dropped: (session_id, message_id, id, tokens).

    Newest first, past the last two user turns and down to a barrier (a summary
    reply, or an output dropped earlier): outputs beyond ``protect`` tokens, if
    they make up more than ``minimum`` in the session.
    """
    newest = messages.where("role = 'user'").groupBy("session_id").agg(F.max("id").alias("_newest"))
    region = (
        messages.where("role = 'user'")
        .join(newest, "session_id")
        .where("id < _newest")
        .groupBy("session_id")
        .agg(F.max("id").alias("_from"))
    )
    summaries = messages.where("role = 'assistant' AND summary").select(
        "session_id", F.struct(F.col("id").alias("message_id"), F.lit(1).alias("all"), F.lit(None).cast("long").alias("id")).alias("_at")
    )
    done = parts.where("type = 'tool' AND status = 'completed'").where(~F.col("tool").isin(*protected_tools))
    dropped = done.where("compacted IS NOT NULL").select(
        "session_id", F.struct("message_id", F.lit(0).alias("all"), "id").alias("_at")
    )
    barrier = (
        summaries.unionByName(dropped)
        .join(region, "session_id")
        .where("_at.message_id <= _from")
        .groupBy("session_id")
        .agg(F.max("_at").alias("_barrier"))
    )
    here = F.struct("message_id", F.lit(0).alias("all"), "id")
    eligible = (
        done.join(region, "session_id")
        .where("message_id <= _from")
        .join(barrier, "session_id", "left")
        .where(F.col("_barrier").isNull() | (here > F.col("_barrier")))
        .select("session_id", "message_id", "id", estimate_tokens(F.col("output")).alias("tokens"))
    )
    # Narrow rows out of several joins: written once, as the scan reads its input more than once.
    counted = running(
        checkpointed(eligible),
        ["session_id"],
        ["message_id", "id"],
        {"_seen": ("sum", F.col("tokens"))},
        descending=True,
    )
    marked = counted.where(F.col("_seen") > protect).drop("_seen")
    enough = marked.groupBy("session_id").agg(F.sum("tokens").alias("_sum")).where(F.col("_sum") > minimum)
    return marked.join(enough.select("session_id"), "session_id", "left_semi")


def overflow(messages: DataFrame, models: DataFrame, auto: bool = True) -> DataFrame:
    """Assistant messages with ``overflow``: whether they pass the usable context of their model, null if no limits are known."""
    capped = F.least(F.col("output_limit"), F.lit(OUTPUT_TOKEN_MAX))
    output = F.coalesce(F.nullif(capped, F.lit(0)), F.lit(OUTPUT_TOKEN_MAX))
    usable = F.coalesce(F.nullif(F.col("input_limit"), F.lit(0)), F.col("context_limit") - output)
    count = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("output_tokens")
    full = F.lit(auto) & (F.col("context_limit") != 0) & (count > usable)
    limits = models.select("provider_id", "model_id", "context_limit", "input_limit", "output_limit")
    return (
        messages.where("role = 'assistant'")
        .join(limits, ["provider_id", "model_id"], "left")
        .select(*messages.columns, full.alias("overflow"))
    )


def repeat_calls(parts: DataFrame, times: int = 3) -> DataFrame:
    """Messages whose last ``times`` parts are started calls of one tool with one input."""
    started = (F.col("type") == "tool") & (F.col("status") != "pending")
    call = F.when(started, F.struct("tool", "input"))
    rows = parts.select("message_id", "id", call.alias("call"))
    last = rows.groupBy("message_id").agg(F.max_by(F.struct("call"), "id").alias("_last"))
    last = last.where("_last.call IS NOT NULL").select("message_id", F.col("_last.call").alias("_call"))
    joined = rows.join(last, "message_id").withColumn("_same", F.coalesce(F.col("call") == F.col("_call"), F.lit(False)))
    differs = joined.where("NOT _same").groupBy("message_id").agg(F.max("id").alias("_differs"))
    run = (
        joined.join(differs, "message_id", "left")
        .where(F.col("_differs").isNull() | (F.col("id") > F.col("_differs")))
        .groupBy("message_id")
        .agg(F.max("_call").alias("_call"), F.count("*").alias("run"))
    )
    return run.where(F.col("run") >= times).select("message_id", "_call.tool", "_call.input", "run")


def last_of_kind(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Per session: last user, assistant and finished message, pending tasks after it, and whether it is done."""
    reply = F.col("role") == "assistant"
    marks = messages.groupBy("session_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("id"))).alias("last_user"),
        F.max(F.when(reply, F.col("id"))).alias("last_assistant"),
        F.max(F.when(reply & F.col("finish").isNotNull(), F.col("id"))).alias("last_finished"),
        F.max_by("finish", F.when(reply, F.col("id"))).alias("_finish"),
    )
    tasks = (
        parts.where("type IN ('compaction', 'subtask')")
        .join(marks.select("session_id", "last_finished"), "session_id")
        .where("last_finished IS NULL OR message_id > last_finished")
        .groupBy("session_id")
        .agg(F.count("*").alias("tasks"))
    )
    finished = F.col("_finish").isNotNull() & ~F.col("_finish").isin("tool-calls", "unknown")
    return marks.join(tasks, "session_id", "left").select(
        "session_id",
        "last_user",
        "last_assistant",
        "last_finished",
        F.coalesce("tasks", F.lit(0)).alias("tasks"),
        F.coalesce(finished & (F.col("last_user") < F.col("last_assistant")), F.lit(False)).alias("done"),
    )


def snapshot_bounds(parts: DataFrame) -> DataFrame:
    """First step-start snapshot and the first step-finish snapshot of the last message that has one."""
    marked = parts.where("snapshot IS NOT NULL")
    per_message = marked.groupBy("session_id", "message_id").agg(
        F.min_by("snapshot", F.when(F.col("type") == "step-start", F.col("id"))).alias("_start"),
        F.min_by("snapshot", F.when(F.col("type") == "step-finish", F.col("id"))).alias("_finish"),
    )
    return (
        per_message.groupBy("session_id")
        .agg(
            F.min_by("_start", F.when(F.col("_start").isNotNull(), F.col("message_id"))).alias("from_snapshot"),
            F.max_by("_finish", F.when(F.col("_finish").isNotNull(), F.col("message_id"))).alias("to_snapshot"),
        )
        .where("from_snapshot IS NOT NULL AND to_snapshot IS NOT NULL")
    )


# -- reverting ---------------------------------------------------------------------


def _revert_targets(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets whose part exists, with ``_at`` = the part the cut falls on."""
    of_message = parts.select("session_id", "message_id", F.col("id").alias("_part"), "type")
    rows = of_message.join(targets, ["session_id", "message_id"])
    hit = F.col("part_id").isNull() | (F.col("_part") == F.col("part_id"))
    first = rows.where(hit).groupBy("session_id", "message_id").agg(F.min("_part").alias("_at"))
    return targets.join(first, ["session_id", "message_id"])


def revert_point(messages: DataFrame, parts: DataFrame, targets: DataFrame) -> DataFrame:
    """Where to cut each session: (session_id, message_id, part_id).

    ``targets`` has (session_id, message_id, part_id), one per session. When
    nothing useful would stay in the message, the cut moves to its user message.
    """
    cut = _revert_targets(parts, targets)
    before = (
        parts.select("session_id", "message_id", F.col("id").alias("_part"), "type")
        .join(cut, ["session_id", "message_id"])
        .where("_part < _at AND type IN ('text', 'tool')")
        .select("session_id", "message_id", F.lit(True).alias("_useful"))
        .distinct()
    )
    users = (
        messages.where("role = 'user'")
        .select("session_id", F.col("id").alias("_user"))
        .join(cut.select("session_id", "message_id"), "session_id")
        .where("_user <= message_id")
        .groupBy("session_id")
        .agg(F.max("_user").alias("_user"))
    )
    part = F.when(F.coalesce("_useful", F.lit(False)), F.col("part_id"))
    return (
        cut.join(before, ["session_id", "message_id"], "left")
        .join(users, "session_id", "left")
        .select(
            "session_id",
            F.when(part.isNull(), F.coalesce("_user", "message_id")).otherwise(F.col("message_id")).alias("message_id"),
            part.alias("part_id"),
        )
    )


def revert_patches(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """Patch parts after the cut of each session."""
    cut = _revert_targets(parts, targets).select("session_id", F.col("message_id").alias("_message"), "_at")
    later = (F.col("message_id") > F.col("_message")) | ((F.col("message_id") == F.col("_message")) & (F.col("id") > F.col("_at")))
    return parts.where("type = 'patch'").join(cut, "session_id").where(later).select(*parts.columns)


def revert_cleanup(messages: DataFrame, parts: DataFrame, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and parts that stay when each session is cut at (message_id, part_id)."""
    real = cut.join(messages.select("session_id", F.col("id").alias("message_id")), ["session_id", "message_id"], "left_semi")
    real = real.select("session_id", F.col("message_id").alias("_message"), F.col("part_id").alias("_part"))
    kept = messages.join(real, "session_id", "left").where(F.col("_message").isNull() | (F.col("id") < F.col("_message")))
    last = kept.where("_part IS NOT NULL").groupBy("session_id").agg(F.max("id").alias("message_id"), F.max("_part").alias("id"))
    inside = parts.select("session_id", "message_id", "id").join(last, ["session_id", "message_id", "id"], "left_semi")
    limit = inside.select("session_id", "message_id", F.col("id").alias("_limit"))
    kept_parts = (
        parts.join(real, "session_id", "left")
        .where(F.col("_message").isNull() | (F.col("message_id") < F.col("_message")))
        .join(limit, ["session_id", "message_id"], "left")
        .where(F.col("_limit").isNull() | (F.col("id") < F.col("_limit")))
    )
    return kept.select(*messages.columns), kept_parts.select(*parts.columns)


# -- files -------------------------------------------------------------------------


def _patched(parts: DataFrame) -> DataFrame:
    return parts.where("type = 'patch'").select("session_id", "message_id", "id", F.explode("files").alias("file"))


def first_patch_per_file(parts: DataFrame) -> DataFrame:
    return _patched(parts).groupBy("session_id", "file").agg(F.min_by("id", F.struct("message_id", "id")).alias("patch_id"))


def changed_files(parts: DataFrame) -> DataFrame:
    return _patched(parts).select("session_id", "file").distinct()


def changed_files_diff(diffs: DataFrame, parts: DataFrame) -> DataFrame:
    """Diffs of files that some patch of the session names."""
    return diffs.join(changed_files(parts), ["session_id", "file"], "left_semi")


def diff_totals(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("session_id").agg(
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("*").alias("files")
    )


# -- figures per session -----------------------------------------------------------


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("cost_nano"))), F.lit(0)).alias("cost_nano"),
    )


def _last_with_tokens(messages: DataFrame) -> DataFrame:
    total = sum(
        (F.coalesce(f"{n}_tokens", F.lit(0)) for n in ("output", "reasoning", "cache_read", "cache_write")),
        F.coalesce("input_tokens", F.lit(0)),
    )
    rows = messages.where("role = 'assistant'").withColumn("total_tokens", total).where("total_tokens > 0")
    return rows.groupBy("session_id").agg(
        F.max_by(F.struct("id", "provider_id", "model_id", "input_tokens", "total_tokens"), "id").alias("m")
    ).select("session_id", "m.*")


def context_usage(messages: DataFrame, models: DataFrame) -> DataFrame:
    """Tokens of the last reply and their share of the model's context, in whole percent."""
    limit = F.nullif(F.col("context_limit"), F.lit(0))
    return (
        _last_with_tokens(messages)
        .join(models.select("provider_id", "model_id", "context_limit"), ["provider_id", "model_id"], "left")
        .select(
            "session_id",
            F.col("id").alias("message_id"),
            "total_tokens",
            F.floor(F.col("total_tokens") / limit * 100 + 0.5).cast("long").alias("percent"),
        )
    )


def context_breakdown(messages: DataFrame, parts: DataFrame, system_chars: int = 0) -> DataFrame:
    """Estimated share of the context by source: (session_id, key, tokens, percent)."""
    roles = messages.select(F.col("id").alias("message_id"), "role")
    size = lambda c: F.coalesce(utf16_length(F.col(c)), F.lit(0))
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    spoken = F.col("type").isin("text", "reasoning")
    call = (
        F.coalesce(F.array_size(F.json_object_keys("input")), F.lit(0)) * 16
        + F.when(F.col("status") == "completed", size("output")).when(F.col("status") == "error", size("error")).otherwise(0)
    )
    chars = (
        parts.join(roles, "message_id")
        .groupBy("session_id")
        .agg(
            F.sum(F.when(user & (F.col("type") == "text"), size("text")).otherwise(0)).alias("user"),
            F.sum(F.when(reply & spoken, size("text")).otherwise(0)).alias("assistant"),
            F.sum(F.when(reply & (F.col("type") == "tool"), call).otherwise(0)).alias("tool"),
        )
    )
    quarter = lambda c: F.ceil(c / 4).cast("long")
    names = ("system", "user", "assistant", "tool")
    rows = (
        _last_with_tokens(messages)
        .where("input_tokens > 0")
        .select("session_id", F.col("input_tokens").alias("input"))
        .join(chars, "session_id", "left")
        .withColumn("system", F.lit(system_chars))
        .select("session_id", "input", *[quarter(F.coalesce(n, F.lit(0))).alias(n) for n in names])
        .withColumn("estimated", F.expr(" + ".join(names)))
    )
    scale = F.col("input") / F.col("estimated")
    fits = F.col("estimated") <= F.col("input")
    fitted = rows.select(
        "session_id", "input", *[F.when(fits, F.col(n)).otherwise(F.floor(F.col(n) * scale)).cast("long").alias(n) for n in names]
    )
    other = F.greatest(F.lit(0), F.col("input") - F.expr(" + ".join(names)))
    stacked = fitted.withColumn("other", other).select(
        "session_id",
        "input",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("long").alias("tokens")) for n in (*names, "other")])
        ).alias("s"),
    )
    percent = F.floor(F.col("s.tokens") / F.col("input") * 100 * 10 + 0.5) / 10
    return stacked.where("s.tokens > 0").select("session_id", "s.key", "s.tokens", percent.alias("percent"))
