"""Queries over sessions, messages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import estimate_tokens
from tidemark.operators import messages as M
from tidemark.operators import sessions as S
from tidemark.operators import stats as T
from tidemark.plans.registry import query
from tidemark.plans.views import NOW_MS, SESSION_EPOCH_MS, Views, tok, u16

# 2024-01-03 04:00, inside the range of the session view.
SEEN_MS = SESSION_EPOCH_MS + 52 * 3600000
ROOTS = "SELECT id FROM v_sessions WHERE project_id = 1"

_DIFFS = """
    diffs AS (SELECT doc_id % 97 AS session_id, 'f' || (doc_id % 8) AS file,
      CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS additions, CAST(sum(n_chars % 10) AS BIGINT) AS deletions
      FROM documents GROUP BY 1, 2)"""


def diffs(v: Views):
    """File diffs per session, taken from the documents."""
    return (
        v.table("documents")
        .groupBy((F.col("doc_id") % 97).alias("session_id"), F.concat(F.lit("f"), F.col("doc_id") % 8).alias("file"))
        .agg(
            F.sum(F.size(F.split("text", "\n"))).alias("additions"),
            F.sum(F.col("n_chars") % 10).alias("deletions"),
        )
    )


# -- lists -----------------------------------------------------------------------


@query("filter_recent_sessions", f"SELECT id, updated FROM v_sessions WHERE updated >= {SEEN_MS} - 86400000 AND project_id = 2")
def _(v: Views):
    return S.filter_recent_sessions(v.sessions(), SEEN_MS, 1, 2).select("id", "updated")


@query(
    "list_sessions",
    f"""SELECT id, title FROM v_sessions WHERE directory = '/work/p1' AND parent_id IS NULL AND updated >= {SESSION_EPOCH_MS} + 7200000
        AND contains(lower(title), 'en') ORDER BY id LIMIT 20""",
)
def _(v: Views):
    return S.list_sessions(v.sessions(), "/work/p1", True, SESSION_EPOCH_MS + 7200000, "EN", 20).select("id", "title")


@query(
    "filter_default_titles",
    r"""SELECT id, title FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'New session - ' || strftime(make_timestamp(created * 1000), '%Y-%m-%dT%H:%M:%S.000Z')
          WHEN 1 THEN title ELSE 'Child session - ' || id END AS title FROM v_sessions)
        WHERE regexp_full_match(title, '(New session - |Child session - )\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z')""",
)
def _(v: Views):
    stamp = F.date_format(F.timestamp_millis("created"), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    title = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("New session - "), stamp))
        .when(F.col("id") % 3 == 1, F.col("title"))
        .otherwise(F.concat(F.lit("Child session - "), "id"))
    )
    return S.filter_default_titles(v.sessions().select("id", title.alias("title")))


@query("recent_root_sessions", "SELECT id, updated FROM v_sessions WHERE parent_id IS NULL ORDER BY updated DESC, id DESC LIMIT 10")
def _(v: Views):
    return S.recent_root_sessions(v.sessions(), 10).select("id", "updated")


@query(
    "recent_or_top",
    f"""SELECT id, directory, total FROM (
          SELECT *, row_number() OVER (PARTITION BY directory ORDER BY id) AS n, count(*) OVER (PARTITION BY directory) AS total
          FROM v_sessions WHERE archived IS NULL AND parent_id IS NULL)
        WHERE n <= 5 OR updated > {SEEN_MS} - 14400000""",
)
def _(v: Views):
    return S.recent_or_top(v.sessions(), SEEN_MS, 5).select("id", "directory", "total")


_BELOW = f"""
    tree AS (SELECT r.id AS root_id, s.id, CAST(1 AS BIGINT) AS depth FROM ({ROOTS}) r JOIN v_sessions s ON s.parent_id = r.id
             UNION ALL SELECT t.root_id, s.id, t.depth + 1 FROM tree t JOIN v_sessions s ON s.parent_id = t.id)"""


@query("session_descendants", f"WITH RECURSIVE {_BELOW} SELECT * FROM tree")
def _(v: Views):
    sessions = v.sessions()
    return S.session_descendants(sessions, sessions.where("project_id = 1").select("id"))


@query(
    "cascade_delete",
    f"""WITH RECURSIVE {_BELOW}, gone AS ({ROOTS} UNION SELECT id FROM tree)
        SELECT 'session' AS kind, id FROM v_sessions WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'message', id FROM v_messages WHERE session_id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'part', id FROM v_parts WHERE session_id NOT IN (SELECT id FROM gone)""",
)
def _(v: Views):
    sessions = v.sessions()
    left = S.cascade_delete(sessions, v.messages(), v.parts(), sessions.where("project_id = 1").select("id"))
    tagged = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in zip(("session", "message", "part"), left)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def _fork_points(v: Views):
    return (
        v.messages()
        .where("role = 'user'")
        .groupBy("session_id")
        .agg(F.max("id").alias("at"))
        .withColumn("new_session_id", F.col("session_id") + 1_000_000)
    )


_FORK = """
    points AS (SELECT session_id, max(id) AS at, session_id + 1000000 AS new_session_id FROM v_messages WHERE role = 'user' GROUP BY 1),
    copies AS (SELECT m.*, p.new_session_id, p.new_session_id * 1000 + row_number() OVER (PARTITION BY m.session_id ORDER BY m.id) - 1 AS new_id
               FROM v_messages m JOIN points p ON p.session_id = m.session_id AND m.id < p.at)"""


@query(
    "fork_sessions",
    f"""WITH {_FORK} SELECT c.new_id AS id, c.new_session_id AS session_id, p.new_id AS parent_id, c.id AS source_id, c.role
        FROM copies c LEFT JOIN copies p ON p.session_id = c.session_id AND p.id = c.parent_id""",
)
def _(v: Views):
    return S.fork_messages(v.messages(), _fork_points(v)).select("id", "session_id", "parent_id", "source_id", "role")


@query(
    "fork_parts",
    f"""WITH {_FORK} SELECT c.new_id * 1000 + row_number() OVER (PARTITION BY p.message_id ORDER BY p.id) - 1 AS id,
          c.new_id AS message_id, c.new_session_id AS session_id, p.id AS source_id, p.type
        FROM copies c JOIN v_parts p ON p.message_id = c.id""",
)
def _(v: Views):
    forked = S.fork_messages(v.messages(), _fork_points(v))
    return S.fork_parts(v.parts(), forked).select("id", "message_id", "session_id", "source_id", "type")


# -- bundles ---------------------------------------------------------------------


@query(
    "messages_with_parts",
    """SELECT m.id, m.role, count(p.id) AS n_parts, md5(coalesce(string_agg(p.id || ':' || p.type, ',' ORDER BY p.id), '')) AS digest
       FROM v_messages m LEFT JOIN v_parts p ON p.message_id = m.id GROUP BY 1, 2""",
)
def _(v: Views):
    full = S.messages_with_parts(v.messages(), v.parts().select("id", "message_id", "session_id", "type"))
    listed = F.transform("parts", lambda p: F.concat(p["id"].cast("string"), F.lit(":"), p["type"]))
    return full.select(
        "id", "role", F.size("parts").cast("long").alias("n_parts"), F.md5(F.array_join(listed, ",")).alias("digest")
    )


@query(
    "export_sessions",
    """SELECT s.id AS session_id, CAST(0 AS BIGINT) AS chunk, s.title, count(DISTINCT m.id) AS n_messages,
         string_agg(DISTINCT m.id, ',' ORDER BY m.id) AS ids
       FROM v_sessions s JOIN v_messages m ON m.session_id = s.id GROUP BY 1, 3""",
)
def _(v: Views):
    bundles = S.export_sessions(v.sessions(), v.messages(), v.parts().drop("output"))
    ids = F.from_json("bundle", "messages array<struct<id: bigint>>")["messages"]["id"]
    return bundles.select(
        "session_id",
        "chunk",
        F.get_json_object("bundle", "$.info.title").alias("title"),
        F.size(ids).cast("long").alias("n_messages"),
        F.array_join(ids.cast("array<string>"), ",").alias("ids"),
    )


@query(
    "import_sessions",
    """SELECT 'session' AS kind, id, md5(title) AS digest FROM v_sessions
       UNION ALL SELECT 'message', id, md5(role || coalesce(cost_nano, 0)) FROM v_messages
       UNION ALL SELECT 'part', id, md5(type || coalesce(text, '') || coalesce(output, '')) FROM v_parts""",
)
def _(v: Views):
    sessions, messages, parts = v.sessions(), v.messages(), v.parts()
    bundles = S.export_sessions(sessions, messages, parts)
    back = S.import_sessions(bundles, sessions.schema, messages.schema, parts.schema)
    empty = F.lit("")
    return (
        back[0]
        .select(F.lit("session").alias("kind"), "id", F.md5("title").alias("digest"))
        .unionByName(
            back[1].select(
                F.lit("message").alias("kind"), "id", F.md5(F.concat("role", F.coalesce("cost_nano", F.lit(0)))).alias("digest")
            )
        )
        .unionByName(
            back[2].select(
                F.lit("part").alias("kind"),
                "id",
                F.md5(F.concat("type", F.coalesce("text", empty), F.coalesce("output", empty))).alias("digest"),
            )
        )
    )


@query(
    "full_sync",
    f"""WITH {_DIFFS}
        SELECT id AS session_id, 'session' AS kind, 'session' AS entity_key FROM v_sessions
        UNION ALL SELECT session_id, 'message', 'message/' || id FROM v_messages
        UNION ALL SELECT session_id, 'part', 'part/' || message_id || '/' || id FROM v_parts
        UNION ALL SELECT session_id, 'session_diff', 'session_diff/' || file FROM diffs
        UNION ALL SELECT DISTINCT session_id, 'model', 'model/' || model_id FROM v_messages WHERE model_id IS NOT NULL""",
)
def _(v: Views):
    messages = v.messages()
    models = messages.where("model_id IS NOT NULL").select("session_id", "provider_id", "model_id").distinct()
    return S.full_sync(v.sessions(), messages, v.parts(), diffs(v), models).drop("data")


# -- transcripts -----------------------------------------------------------------

_KEPT = """
    kept AS (
      SELECT m.session_id, m.id AS message_id, m.role, p.id, p.type AS raw,
        m.role = 'assistant' AND m.error IS NOT NULL AS failed, m.error,
        CASE WHEN m.role = 'user' THEN CASE p.type WHEN 'text' THEN 'text||' || p.text WHEN 'compaction' THEN 'text||What did we do so far?' END
             WHEN p.type IN ('text', 'reasoning') THEN p.type || '||' || p.text
             WHEN p.type = 'step-start' THEN 'step-start||'
             WHEN p.type = 'tool' THEN 'tool-' || p.tool || '|' || CASE WHEN p.status = 'completed' THEN 'output-available|' || p.output
               ELSE 'output-error|' || p.error END END AS rec
      FROM v_messages m JOIN v_parts p ON p.message_id = m.id),
    useful AS (SELECT message_id, bool_or(raw NOT IN ('step-start', 'reasoning')) AS progress,
                 bool_or(rec IS NOT NULL AND raw <> 'step-start') AS content FROM kept GROUP BY 1)"""


@query(
    "project_model_messages",
    f"""WITH {_KEPT} SELECT session_id, message_id, role, CAST(0 AS BIGINT) AS chunk, count(*) AS n_parts,
          md5(string_agg(rec, ';' ORDER BY id)) AS digest
        FROM kept JOIN useful USING (message_id)
        WHERE rec IS NOT NULL AND content AND NOT (failed AND NOT (error = 'MessageAbortedError' AND progress))
        GROUP BY 1, 2, 3""",
)
def _(v: Views):
    empty = F.lit("")
    line = lambda p: F.concat(
        p["type"], F.lit("|"), F.coalesce(p["state"], empty), F.lit("|"), F.coalesce(p["text"], empty)
    )
    return M.project_model_messages(v.messages(), v.parts()).select(
        "session_id",
        "message_id",
        "role",
        "chunk",
        F.size("parts").cast("long").alias("n_parts"),
        F.md5(F.array_join(F.transform("parts", line), ";")).alias("digest"),
    )


_STAMP = lambda c: f"strftime(make_timestamp({c} * 1000), '%-m/%-d/%Y, %-I:%M:%S %p')"


@query(
    "render_transcripts",
    f"""WITH pieces AS (
          SELECT id AS session_id, -1 AS message_id, 0 AS step, -1 AS part_id, '# ' || title || chr(10) || chr(10) || '**Session ID:** ' || id
            || chr(10) || '**Created:** ' || {_STAMP('created')} || chr(10) || '**Updated:** ' || {_STAMP('updated')}
            || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS t FROM v_sessions
          UNION ALL
          SELECT session_id, id, 0, -1, CASE role WHEN 'user' THEN '## User' ELSE '## Assistant (' || upper(agent[1]) || agent[2:] || ' · ' || model_id
            || ' · ' || printf('%.1fs', (completed - created) / 1000) || ')' END || chr(10) || chr(10) FROM v_messages
          UNION ALL
          SELECT session_id, id, 2, -1, '---' || chr(10) || chr(10) FROM v_messages
          UNION ALL
          SELECT session_id, message_id, 1, id, CASE type WHEN 'text' THEN text || chr(10) || chr(10)
            WHEN 'reasoning' THEN '_Thinking:_' || chr(10) || chr(10) || text || chr(10) || chr(10)
            WHEN 'tool' THEN '```' || chr(10) || 'Tool: ' || tool || chr(10) || chr(10) || '**Input:**' || chr(10) || '```json' || chr(10)
              || '{{' || chr(10) || '  "n": ' || json_extract_string(input, '$.n') || chr(10) || '}}' || chr(10) || '```'
              || CASE WHEN output <> '' THEN chr(10) || '**Output:**' || chr(10) || '```' || chr(10) || output || chr(10) || '```' ELSE '' END
              || CASE WHEN error <> '' THEN chr(10) || '**Error:**' || chr(10) || '```' || chr(10) || error || chr(10) || '```' ELSE '' END
              || chr(10) || '```' || chr(10) || chr(10) END
          FROM v_parts WHERE type IN ('text', 'reasoning', 'tool'))
        SELECT session_id, CAST(0 AS BIGINT) AS chunk, md5(string_agg(t, '' ORDER BY message_id, step, part_id)) AS digest
        FROM pieces GROUP BY 1""",
)
def _(v: Views):
    return M.render_transcripts(v.sessions(), v.messages(), v.parts()).select(
        "session_id", "chunk", F.md5("text").alias("digest")
    )


@query(
    "turns",
    """WITH u AS (SELECT *, lead(id) OVER (PARTITION BY session_id ORDER BY id) AS next_id FROM v_messages WHERE role = 'user')
       SELECT u.session_id, u.id, count(r.id) AS replies, max(r.id) AS last_reply,
         arg_min(r.error, r.id) FILTER (r.error IS NOT NULL) AS first_error, arg_max(r.completed, r.id) - max(u.created) AS duration_ms
       FROM u LEFT JOIN v_messages r ON r.role = 'assistant' AND r.session_id = u.session_id AND r.parent_id = u.id AND r.id > u.id
         AND (u.next_id IS NULL OR r.id < u.next_id)
       GROUP BY 1, 2""",
)
def _(v: Views):
    return M.turns(v.messages())


# -- context ---------------------------------------------------------------------


@query(
    "active_context",
    """WITH cut AS (
         SELECT u.session_id, max(u.id) AS cut FROM v_messages u
         JOIN v_messages s ON s.session_id = u.session_id AND s.parent_id = u.id AND s.id > u.id AND s.summary AND s.finish IS NOT NULL
         WHERE u.role = 'user' AND u.id IN (SELECT message_id FROM v_parts WHERE type = 'compaction') GROUP BY 1)
       SELECT m.id, m.session_id, m.role FROM v_messages m LEFT JOIN cut USING (session_id) WHERE cut IS NULL OR m.id >= cut""",
)
def _(v: Views):
    return M.active_context(v.messages(), v.parts()).select("id", "session_id", "role")


@query(
    "prune_tool_outputs",
    f"""WITH turned AS (
          SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id DESC) AS turns FROM v_messages),
        region AS (SELECT * FROM turned WHERE turns >= 2),
        open AS (SELECT *, max(CASE WHEN role = 'assistant' AND summary THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id DESC) AS barrier FROM region),
        eligible AS (SELECT p.session_id, p.message_id, p.id, CAST({tok('p.output')} AS BIGINT) AS tokens
                     FROM v_parts p JOIN open o ON o.id = p.message_id
                     WHERE o.barrier = 0 AND p.type = 'tool' AND p.status = 'completed' AND p.tool <> 'skill'),
        marked AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY message_id DESC, id DESC) AS seen FROM eligible) WHERE seen > 40000)
        SELECT session_id, message_id, id, tokens FROM marked
        WHERE session_id IN (SELECT session_id FROM marked GROUP BY 1 HAVING sum(tokens) > 20000)""",
)
def _(v: Views):
    return M.prune_tool_outputs(v.messages(), v.parts())


@query(
    "overflow",
    """SELECT m.id, x.context_limit <> 0 AND m.input_tokens + m.cache_read_tokens + m.output_tokens
         > coalesce(x.input_limit, x.context_limit - least(x.output_limit, 32000)) AS overflow
       FROM v_messages m LEFT JOIN (SELECT * FROM v_models WHERE model_id <> 'small') x
         USING (provider_id, model_id) WHERE m.role = 'assistant'""",
)
def _(v: Views):
    # One model without known limits.
    return M.overflow(v.messages(), v.models().where("model_id <> 'small'")).select("id", "overflow")


@query(
    "repeat_calls",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY id DESC) AS n,
                    first_value(struct_pack(a := tool, b := input)) OVER (PARTITION BY message_id ORDER BY id DESC) AS last FROM v_parts WHERE type <> 'step-finish'),
       d AS (SELECT message_id, min(n) FILTER (type <> 'tool' OR status = 'pending' OR struct_pack(a := tool, b := input) <> last) AS stop, count(*) AS total FROM p GROUP BY 1)
       SELECT p.message_id, p.tool, p.input, coalesce(d.stop - 1, d.total) AS run FROM p JOIN d USING (message_id)
       WHERE p.n = 1 AND p.type = 'tool' AND coalesce(d.stop - 1, d.total) >= 3""",
)
def _(v: Views):
    return M.repeat_calls(v.parts().where("type <> 'step-finish'"))


@query(
    "last_of_kind",
    """WITH k AS (SELECT session_id, max(id) FILTER (role = 'user') AS last_user, max(id) FILTER (role = 'assistant') AS last_assistant,
                    max(id) FILTER (role = 'assistant' AND finish IS NOT NULL) AS last_finished FROM v_messages GROUP BY 1)
       SELECT k.*, (SELECT count(*) FROM v_parts p WHERE p.session_id = k.session_id AND p.type IN ('compaction', 'subtask')
                      AND (k.last_finished IS NULL OR p.message_id > k.last_finished)) AS tasks,
         coalesce(k.last_finished = k.last_assistant AND k.last_user < k.last_assistant, false) AS done FROM k""",
)
def _(v: Views):
    return M.last_of_kind(v.messages(), v.parts())


@query(
    "snapshot_bounds",
    """SELECT session_id, arg_min(snapshot, id) FILTER (type = 'step-start') AS from_snapshot,
         arg_max(snapshot, message_id) FILTER (type = 'step-finish') AS to_snapshot
       FROM v_parts GROUP BY 1 HAVING from_snapshot IS NOT NULL AND to_snapshot IS NOT NULL""",
)
def _(v: Views):
    return M.snapshot_bounds(v.parts())


# -- reverting -------------------------------------------------------------------

_TARGETS = """
    last_reply AS (SELECT session_id, max(id) AS message_id FROM v_messages WHERE role = 'assistant' GROUP BY 1),
    targets AS (SELECT l.session_id, l.message_id,
        CASE WHEN l.session_id % 2 = 1 THEN (SELECT max(id) FROM v_parts p WHERE p.message_id = l.message_id AND p.type IN ('text', 'tool')) END AS part_id
      FROM last_reply l),
    hit AS (SELECT t.*, (SELECT min(id) FROM v_parts p WHERE p.message_id = t.message_id AND (t.part_id IS NULL OR p.id = t.part_id)) AS at FROM targets t),
    points AS (
      SELECT session_id, CASE WHEN keep IS NULL THEN coalesce(usr, message_id) ELSE message_id END AS message_id, keep AS part_id
      FROM (SELECT h.session_id, h.message_id,
              CASE WHEN EXISTS (SELECT 1 FROM v_parts p WHERE p.message_id = h.message_id AND p.id < h.at AND p.type IN ('text', 'tool')) THEN h.part_id END AS keep,
              (SELECT max(id) FROM v_messages m WHERE m.session_id = h.session_id AND m.role = 'user' AND m.id <= h.message_id) AS usr
            FROM hit h WHERE h.at IS NOT NULL))"""


def _targets(v: Views):
    last = v.messages().where("role = 'assistant'").groupBy("session_id").agg(F.max("id").alias("message_id"))
    useful = v.parts().where("type IN ('text', 'tool')").groupBy("message_id").agg(F.max("id").alias("_part"))
    return last.join(useful, "message_id", "left").select(
        "session_id", "message_id", F.when(F.col("session_id") % 2 == 1, F.col("_part")).alias("part_id")
    )


@query("revert_point", f"WITH {_TARGETS} SELECT session_id, message_id, part_id FROM points")
def _(v: Views):
    return M.revert_point(v.messages(), v.parts(), _targets(v))


@query(
    "revert_patches",
    f"""WITH {_TARGETS} SELECT p.id, p.session_id FROM v_parts p JOIN hit h USING (session_id)
        WHERE p.type = 'patch' AND h.at IS NOT NULL AND (p.message_id > h.message_id OR (p.message_id = h.message_id AND p.id > h.at))""",
)
def _(v: Views):
    return M.revert_patches(v.parts(), _targets(v)).select("id", "session_id")


@query(
    "revert_cleanup",
    f"""WITH {_TARGETS}
        SELECT 'message' AS kind, m.id FROM v_messages m LEFT JOIN points c USING (session_id) WHERE c.message_id IS NULL OR m.id < c.message_id
        UNION ALL
        SELECT 'part', p.id FROM v_parts p LEFT JOIN points c USING (session_id) WHERE c.message_id IS NULL OR p.message_id < c.message_id""",
)
def _(v: Views):
    messages, parts = v.messages(), v.parts()
    kept = M.revert_cleanup(messages, parts, M.revert_point(messages, parts, _targets(v)))
    return (
        kept[0].select(F.lit("message").alias("kind"), "id").unionByName(kept[1].select(F.lit("part").alias("kind"), "id"))
    )


# -- files -----------------------------------------------------------------------


@query("first_patch_per_file", "SELECT session_id, file, min(id) AS patch_id FROM v_parts WHERE type = 'patch' GROUP BY 1, 2")
def _(v: Views):
    return M.first_patch_per_file(v.parts())


@query("changed_files", "SELECT DISTINCT session_id, file FROM v_parts WHERE type = 'patch'")
def _(v: Views):
    return M.changed_files(v.parts())


@query(
    "changed_files_diff",
    f"""WITH {_DIFFS} SELECT * FROM diffs d WHERE EXISTS (
          SELECT 1 FROM v_parts p WHERE p.type = 'patch' AND p.session_id = d.session_id AND p.file = d.file)""",
)
def _(v: Views):
    return M.changed_files_diff(diffs(v), v.parts())


@query(
    "diff_totals",
    f"""WITH {_DIFFS} SELECT session_id, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
          count(*) AS files FROM diffs GROUP BY 1""",
)
def _(v: Views):
    return M.diff_totals(diffs(v))


# -- figures ---------------------------------------------------------------------


@query(
    "message_counts",
    """SELECT session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages,
         count(*) FILTER (role = 'assistant') AS assistant_messages, CAST(coalesce(sum(cost_nano), 0) AS BIGINT) AS cost_nano
       FROM v_messages GROUP BY 1""",
)
def _(v: Views):
    return M.message_counts(v.messages())


_LAST = """
    totals AS (SELECT *, input_tokens + output_tokens + reasoning_tokens + cache_read_tokens + cache_write_tokens AS total_tokens
               FROM v_messages WHERE role = 'assistant'),
    last AS (SELECT t.* FROM totals t JOIN (SELECT session_id, max(id) AS id FROM totals WHERE total_tokens > 0 GROUP BY 1) USING (session_id, id))"""


@query(
    "context_usage",
    f"""WITH {_LAST} SELECT l.session_id, l.id AS message_id, l.total_tokens,
          CAST(floor(l.total_tokens / nullif(x.context_limit, 0) * 100 + 0.5) AS BIGINT) AS percent
        FROM last l LEFT JOIN v_models x USING (provider_id, model_id)""",
)
def _(v: Views):
    return M.context_usage(v.messages(), v.models())


@query(
    "context_breakdown",
    f"""WITH {_LAST},
        chars AS (SELECT p.session_id,
            sum(CASE WHEN m.role = 'user' AND p.type = 'text' THEN {u16('p.text')} ELSE 0 END) AS u,
            sum(CASE WHEN m.role = 'assistant' AND p.type IN ('text', 'reasoning') THEN {u16('p.text')} ELSE 0 END) AS a,
            sum(CASE WHEN m.role = 'assistant' AND p.type = 'tool' THEN 16 + CASE p.status WHEN 'completed' THEN {u16('p.output')} ELSE {u16('p.error')} END ELSE 0 END) AS t
          FROM v_parts p JOIN v_messages m ON m.id = p.message_id GROUP BY 1),
        est AS (SELECT l.session_id, l.input_tokens AS inp, 25 AS s, CAST(ceil(u / 4) AS BIGINT) AS u, CAST(ceil(a / 4) AS BIGINT) AS a, CAST(ceil(t / 4) AS BIGINT) AS t
                FROM last l JOIN chars USING (session_id) WHERE l.input_tokens > 0),
        fit AS (SELECT session_id, inp, s + u + a + t <= inp AS ok, inp / (s + u + a + t) AS sc, s, u, a, t FROM est),
        scaled AS (SELECT session_id, inp, CASE WHEN ok THEN s ELSE CAST(floor(s * sc) AS BIGINT) END AS s, CASE WHEN ok THEN u ELSE CAST(floor(u * sc) AS BIGINT) END AS u,
                     CASE WHEN ok THEN a ELSE CAST(floor(a * sc) AS BIGINT) END AS a, CASE WHEN ok THEN t ELSE CAST(floor(t * sc) AS BIGINT) END AS t FROM fit)
        SELECT session_id, key, tokens, floor(tokens / inp * 100 * 10 + 0.5) / 10 AS percent FROM (
          SELECT session_id, inp, 'system' AS key, CAST(s AS BIGINT) AS tokens FROM scaled
          UNION ALL SELECT session_id, inp, 'user', u FROM scaled UNION ALL SELECT session_id, inp, 'assistant', a FROM scaled
          UNION ALL SELECT session_id, inp, 'tool', t FROM scaled UNION ALL SELECT session_id, inp, 'other', greatest(0, inp - s - u - a - t) FROM scaled)
        WHERE tokens > 0""",
)
def _(v: Views):
    return M.context_breakdown(v.messages(), v.parts(), 100)


def _stats_sql(cutoff: int | None, days: str) -> str:
    keep = f"WHERE s.updated >= {cutoff}" if cutoff else ""
    return f"""
        WITH per AS (
          SELECT s.id, s.created, s.updated, count(m.id) AS messages, coalesce(sum(m.cost_nano), 0) AS cost, coalesce(sum(m.input_tokens), 0) AS i,
            coalesce(sum(m.output_tokens), 0) AS o, coalesce(sum(m.reasoning_tokens), 0) AS r, coalesce(sum(m.cache_read_tokens), 0) AS cr, coalesce(sum(m.cache_write_tokens), 0) AS cw
          FROM v_sessions s LEFT JOIN v_messages m ON m.session_id = s.id {keep} GROUP BY 1, 2, 3),
        t AS (SELECT count(*) AS sessions, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(cost) AS BIGINT) AS cost_nano, CAST(sum(i) AS BIGINT) AS input_tokens,
            CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(r) AS BIGINT) AS reasoning_tokens, CAST(sum(cr) AS BIGINT) AS cache_read_tokens,
            CAST(sum(cw) AS BIGINT) AS cache_write_tokens, least({NOW_MS}, min({'updated' if cutoff else 'created'})) AS earliest, max(updated) AS latest, median(i + o + r) AS med FROM per),
        d AS (SELECT *, CAST({days} AS BIGINT) AS days FROM t)"""


_STATS_COLUMNS = """sessions, messages, cost_nano, input_tokens, output_tokens, reasoning_tokens, cache_read_tokens, cache_write_tokens,
    earliest, latest, days, cost_nano / days AS cost_per_day_nano, (input_tokens + output_tokens + reasoning_tokens) / sessions AS tokens_per_session"""


@query("session_stats", f"{_stats_sql(None, 'greatest(1, ceil((latest - earliest) / 86400000))')} SELECT {_STATS_COLUMNS} FROM d")
def _(v: Views):
    return T.session_stats(v.sessions(), v.messages(), NOW_MS)


@query("session_stats_recent", f"{_stats_sql(NOW_MS - 19 * 86400000, '19')} SELECT {_STATS_COLUMNS} FROM d")
def _(v: Views):
    return T.session_stats(v.sessions(), v.messages(), NOW_MS, 19)


@query("median_tokens", f"{_stats_sql(None, '1')} SELECT CAST(med AS DOUBLE) AS median_tokens FROM d")
def _(v: Views):
    return T.median_tokens(v.sessions(), v.messages(), NOW_MS)


_MODEL_USAGE = """
    SELECT provider_id || '/' || model_id AS model, count(*) AS messages, CAST(sum(input_tokens) AS BIGINT) AS input,
      CAST(sum(output_tokens + reasoning_tokens) AS BIGINT) AS output, CAST(sum(cost_nano) AS BIGINT) AS cost_nano
    FROM v_messages WHERE role = 'assistant' GROUP BY 1"""
_TOOL_USAGE = """
    SELECT tool, count(*) AS calls, count(*) / CAST(sum(count(*)) OVER () AS BIGINT) * 100 AS percent
    FROM v_parts WHERE type = 'tool' GROUP BY 1"""


@query("model_usage", _MODEL_USAGE)
def _(v: Views):
    return T.model_usage(v.messages())


@query("tool_usage", _TOOL_USAGE)
def _(v: Views):
    return T.tool_usage(v.parts())


@query("top_models", f"SELECT * FROM ({_MODEL_USAGE}) ORDER BY messages DESC, model LIMIT 2")
def _(v: Views):
    return T.top_models(v.messages(), 2)


@query("top_tools", f"SELECT * FROM ({_TOOL_USAGE}) ORDER BY calls DESC, tool LIMIT 2")
def _(v: Views):
    return T.top_tools(v.parts(), 2)


@query("estimate_tokens", f"SELECT doc_id, CAST({tok('text')} AS BIGINT) AS tokens FROM documents")
def _(v: Views):
    return v.table("documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))
