"""Session and message operators on small hand-made sessions."""

import pytest

from tidemark.operators import messages as M
from tidemark.operators import ordered
from tidemark.operators import sessions as S
from tidemark.operators import stats

PART = (
    "id long, message_id long, session_id long, type string, text string, tool string, input string, status string, output string,"
    " error string, compacted long, snapshot string, files array<string>, ignored boolean, mime string, url string, synthetic boolean"
)
NAMES = [c.split()[0] for c in PART.split(", ")]


def parts(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], PART)


def part(id, message_id, type, session_id=1, **more):
    return {"id": id, "message_id": message_id, "session_id": session_id, "type": type, **more}


def messages(spark, *rows):
    schema = (
        "id long, session_id long, role string, parent_id long, summary boolean, finish string, error string, provider_id string,"
        " model_id string, input_tokens long, output_tokens long, reasoning_tokens long, cache_read_tokens long, cache_write_tokens long,"
        " cost_nano long, agent string, created long, completed long"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple({"session_id": 1, "summary": False, **r}.get(n) for n in names) for r in rows], schema)


def user(id, **more):
    return {"id": id, "role": "user", **more}


def reply(id, **more):
    return {"id": id, "role": "assistant", **more}


@pytest.mark.parametrize(
    ("limits", "tokens", "expected"),
    [
        ((100_000, None, 32_000), (75_000, 5_000, 0), True),
        ((200_000, None, 32_000), (100_000, 10_000, 0), False),
        ((100_000, None, 32_000), (50_000, 10_000, 10_000), True),
        ((400_000, 272_000, 128_000), (271_000, 1_000, 2_000), True),
        ((400_000, 272_000, 128_000), (200_000, 20_000, 10_000), False),
        ((200_000, 120_000, 10_000), (50_000, 9_999, 0), False),
        ((0, None, 32_000), (100_000, 10_000, 0), False),
    ],
)
def test_overflow(spark, limits, tokens, expected):
    row = reply(1, provider_id="p", model_id="m", input_tokens=tokens[0], output_tokens=tokens[1], cache_read_tokens=tokens[2])
    models = spark.createDataFrame([("p", "m", *limits)], "provider_id string, model_id string, context_limit long, input_limit long, output_limit long")
    assert M.overflow(messages(spark, row), models).first()["overflow"] is expected
    assert M.overflow(messages(spark, row), models, auto=False).first()["overflow"] is False
    assert [r["overflow"] for r in M.overflow(messages(spark, row), models.where("false")).collect()] == [None]


def tool(id, message_id, chars, **more):
    return part(id, message_id, "tool", tool=more.pop("tool", "read"), status=more.pop("status", "completed"), output="x" * chars, **more)


def test_prune_barriers_and_protection(spark):
    ms = messages(spark, reply(1, summary=True), user(2), reply(3), user(4), reply(5), user(6), reply(7), user(8), reply(9))
    kept = [
        tool(10, 1, 400_000),  # behind the summary
        tool(30, 3, 100_000),
        tool(31, 3, 100_000, tool="skill"),  # protected
        tool(32, 3, 100_000, status="error"),  # not completed
        tool(50, 5, 120_000),
        tool(70, 7, 160_000),  # last two turns start at message 6
        tool(90, 9, 900_000),
    ]
    got = M.prune_tool_outputs(ms, parts(spark, *kept))
    # Past the last two turns: 50 brings the sum to 30 000, 30 to 55 000; 25 000 > 20 000.
    assert [(r.id, r.tokens) for r in got.collect()] == [(30, 25_000)]
    stopped = [{**p, "compacted": 5} if p["id"] == 50 else p for p in kept]
    assert M.prune_tool_outputs(ms, parts(spark, *stopped)).count() == 0
    small = [{**p, "output": "x" * 60_000} if p["id"] == 30 else p for p in kept]
    assert M.prune_tool_outputs(ms, parts(spark, *small)).count() == 0


def test_prune_barrier_in_a_summary_covers_its_own_parts(spark):
    ms = messages(spark, user(1), reply(2), user(3), reply(4, summary=True), user(5), user(6))
    ps = parts(spark, tool(20, 2, 900_000), tool(40, 4, 900_000))
    assert M.prune_tool_outputs(ms, ps).count() == 0


def test_active_context_needs_a_later_finished_summary(spark):
    ms = messages(
        spark, user(1), reply(2, parent_id=1), user(3), reply(4, parent_id=3, summary=True, finish="stop"), user(5),
        reply(6, parent_id=5, summary=True), user(7),
    )
    ps = parts(spark, part(30, 3, "compaction"), part(50, 5, "compaction"))
    assert sorted(r.id for r in M.active_context(ms, ps).collect()) == [3, 4, 5, 6, 7]


def test_model_messages(spark):
    ms = messages(
        spark, user(1), reply(2), reply(3, error="APIError"), reply(4, error="MessageAbortedError"), reply(5, error="MessageAbortedError"),
        reply(6), user(7), user(8),
    )
    ps = parts(
        spark,
        part(10, 1, "text", text="hi"), part(11, 1, "text", text="hidden", ignored=True), part(12, 1, "file", mime="image/png", url="u"),
        part(13, 1, "file", mime="text/plain", url="v"), part(14, 1, "compaction"), part(15, 1, "subtask"),
        part(20, 2, "step-start"), tool(21, 2, 3), tool(22, 2, 3, compacted=9), tool(23, 2, 0, status="pending"),
        part(24, 2, "tool", tool="read", status="error", error="bad"),
        part(30, 3, "text", text="lost"),
        part(40, 4, "step-start"), part(41, 4, "text", text="kept"),
        part(50, 5, "step-start"), part(51, 5, "reasoning", text="lost"),
        part(60, 6, "step-start"),
        part(70, 7, "text", text="x", ignored=True),
    )
    got = {r.message_id: [(p.type, p.state, p.text) for p in r.parts] for r in M.project_model_messages(ms, ps).collect()}
    assert got == {
        1: [("text", None, "hi"), ("file", None, "u"), ("text", None, M.COMPACTION_PROMPT), ("text", None, M.SUBTASK_PROMPT)],
        2: [
            ("step-start", None, None), ("tool-read", "output-available", "xxx"), ("tool-read", "output-available", M.CLEARED_OUTPUT),
            ("tool-read", "output-error", M.INTERRUPTED), ("tool-read", "output-error", "bad"),
        ],
        4: [("step-start", None, None), ("text", None, "kept")],
    }


def test_transcript_switches(spark):
    sessions = spark.createDataFrame([(1, "Title", 0, 1000)], "id long, title string, created long, updated long")
    ms = messages(spark, user(1), reply(2, agent="build", model_id="large", created=0, completed=5400))
    ps = parts(
        spark, part(10, 1, "text", text="Hello"), part(11, 1, "text", text="no", synthetic=True), part(20, 2, "reasoning", text="hm"),
        part(21, 2, "tool", tool="bash", input='{"command":"ls"}', status="completed", output="a.txt"),
    )
    head = "# Title\n\n**Session ID:** 1\n**Created:** 1/1/1970, 12:00:00 AM\n**Updated:** 1/1/1970, 12:00:01 AM\n\n---\n\n## User\n\nHello\n\n---\n\n"
    full = M.render_transcripts(sessions, ms, ps).first()["text"]
    assert full == head + (
        "## Assistant (Build · large · 5.4s)\n\n_Thinking:_\n\nhm\n\n```\nTool: bash\n\n**Input:**\n```json\n{\n  \"command\": \"ls\"\n}\n```"
        "\n**Output:**\n```\na.txt\n```\n```\n\n---\n\n"
    )
    bare = M.render_transcripts(sessions, ms, ps, False, False, False).first()["text"]
    assert bare == head + "## Assistant\n\n```\nTool: bash\n\n```\n\n---\n\n"
    pieces = M.render_transcripts(sessions, ms, ps, size=2).orderBy("chunk").collect()
    assert len(pieces) > 2 and "".join(r.text for r in pieces) == full


def test_repeat_calls(spark):
    call = lambda id, message, n, status="running": part(id, message, "tool", tool="read", input=f'{{"n":{n}}}', status=status)
    ps = parts(
        spark, call(1, 1, 0), call(2, 1, 1), call(3, 1, 1), call(4, 1, 1), call(5, 2, 1), call(6, 2, 1), call(7, 3, 1), call(8, 3, 1),
        call(9, 3, 1, "pending"), call(10, 4, 1), call(11, 4, 1), call(12, 4, 1), part(13, 4, "text", text="x"),
    )
    assert [(r.message_id, r.run) for r in M.repeat_calls(ps).collect()] == [(1, 3)]


def test_revert_moves_to_the_user_message_when_nothing_useful_is_left(spark):
    ms = messages(spark, user(1), reply(2), user(3), reply(4), *[{**m, "session_id": 2, "id": m["id"] + 10} for m in (user(1), reply(2))])
    ps = parts(
        spark, part(20, 2, "text"), part(40, 4, "step-start"), part(41, 4, "reasoning"), part(42, 4, "text"), part(43, 4, "patch", files=["a"]),
        part(120, 12, "text", 2), part(121, 12, "tool", 2), part(122, 12, "patch", 2, files=["b"]),
    )
    target = lambda *rows: spark.createDataFrame(rows, "session_id long, message_id long, part_id long")
    cut = {r.session_id: (r.message_id, r.part_id) for r in M.revert_point(ms, ps, target((1, 4, 42), (2, 12, 121))).collect()}
    assert cut == {1: (3, None), 2: (12, 121)}
    assert sorted(r.id for r in M.revert_patches(ps, target((1, 4, None), (2, 12, 121))).collect()) == [43, 122]
    kept = M.revert_cleanup(ms, ps, target((1, 3, None), (2, 99, None)))
    assert sorted(r.id for r in kept[0].collect()) == [1, 2, 11, 12]
    assert sorted(r.id for r in kept[1].collect()) == [20, 120, 121, 122]


def test_last_of_kind(spark):
    ms = messages(spark, user(1), reply(2, finish="stop"), user(3), {**user(11), "session_id": 2}, {**reply(12, finish="tool-calls"), "session_id": 2})
    ps = parts(spark, part(10, 1, "compaction"), part(30, 3, "subtask"), part(110, 11, "compaction", 2))
    got = {r.session_id: tuple(r)[1:] for r in M.last_of_kind(ms, ps).collect()}
    assert got == {1: (3, 2, 2, 1, False), 2: (11, 12, 12, 0, False)}


def test_descendants_survive_a_cycle(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 2), (5, 6), (6, 5), (7, 3)]
    sessions = spark.createDataFrame(rows, "id long, parent_id long")
    roots = spark.createDataFrame([(1,), (5,)], "id long")
    got = sorted(map(tuple, S.session_descendants(sessions, roots).collect()))
    assert got == [(1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 7, 3), (5, 6, 1)]


def test_descendants_of_many_levels_keep_their_plan_small(spark):
    sessions = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "id long, parent_id long")
    got = S.session_descendants(sessions, sessions.where("id < 2").select("id"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((r, i, i - r) for r in (0, 1) for i in range(r + 1, 9))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("\n") < 5


def test_forks_are_numbered_in_their_session(spark):
    rows = messages(spark, user(7), reply(9, parent_id=7), user(20), reply(21, parent_id=20))
    points = spark.createDataFrame([(1, 5, 21)], "session_id long, new_session_id long, at long")
    forked = S.fork_messages(rows, points)
    got = sorted((r.id, r.session_id, r.parent_id, r.source_id) for r in forked.collect())
    assert got == [(5000, 5, None, 7), (5001, 5, 5000, 9), (5002, 5, None, 20)]
    copied = S.fork_parts(parts(spark, part(3, 9, "text"), part(8, 9, "text"), part(9, 21, "text")), forked)
    assert sorted((r.id, r.message_id, r.source_id) for r in copied.collect()) == [(5001000, 5001, 3), (5001001, 5001, 8)]


def test_wide_rows_are_dealt_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_BYTES", 1 << 18, raising=False)
    ms = messages(spark, user(1), *[reply(m) for m in range(2, 12)])
    # Texts that compress well, most of them in one message; rows that are alike stay.
    ps = parts(spark, *[part(1000 + i, 2, "text", text="x" * 20000 + str(i)) for i in range(300)], *[part(3000 + i // 2, 3 + i % 2, "text", text="y" * 9999) for i in range(80)])
    projected = M.project_model_messages(ms, ps, size=7)
    got = sorted((r.message_id, r.chunk, [p.text[19990:] for p in r.parts]) for r in projected.collect())
    assert [t for m, _, ts in got if m == 2 for t in ts] == ["x" * 10 + str(i) for i in range(300)]
    assert [(m, c, len(ts)) for m, c, ts in got] == [(2, c, min(7, 300 - 7 * c)) for c in range(43)] + [(m, c, min(7, 40 - 7 * c)) for m in (3, 4) for c in range(6)]
    sessions = spark.createDataFrame([(1, "T", 5), (2, "empty", 6)], "id long, title string, updated long")
    bundles = S.export_sessions(sessions, ms, ps, size=3)
    assert sorted((r.session_id, r.chunk) for r in bundles.collect()) == [(1, c) for c in range(4)] + [(2, 0)]
    back = S.import_sessions(bundles, sessions.schema, ms.schema, ps.schema)
    for found, want in zip(back, (sessions, ms, ps)):
        assert sorted(map(repr, found.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    # 6.8 MB of text in tasks of 256 KB, whatever it is compressed to.
    assert projected.rdd.getNumPartitions() >= 26
    assert back[2].rdd.getNumPartitions() >= 26


def test_export_import_round_trip_in_small_chunks(spark):
    ms = messages(spark, user(1), reply(2), user(3))
    ps = parts(spark, *[part(10 * m + i, m, "text", text=f"{m}-{i}") for m in (1, 2) for i in range(5)])
    sessions = spark.createDataFrame([(1, "T", 5)], "id long, title string, updated long")
    bundles = S.export_sessions(sessions, ms, ps, size=2)
    assert bundles.count() == 2
    back = S.import_sessions(bundles, sessions.schema, ms.schema, ps.schema)
    for got, want in zip(back, (sessions, ms, ps)):
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_stats_of_nothing(spark):
    sessions = spark.createDataFrame([], "id long, project_id long, created long, updated long")
    row = stats.session_stats(sessions, messages(spark, user(1)), 1000).first()
    assert (row.sessions, row.messages, row.days, row.cost_per_day_nano) == (0, 0, 0, 0.0)


def test_list_sessions_filters(spark):
    rows = [(1, "/a", None, 5, "Fix Bug"), (2, "/a", 1, 9, "child"), (3, "/b", None, 9, "bugs")]
    sessions = spark.createDataFrame(rows, "id long, directory string, parent_id long, updated long, title string")
    ids = lambda **f: [r.id for r in S.list_sessions(sessions, **f).collect()]
    assert ids(directory="/a") == [1, 2]
    assert ids(roots=True) == [1, 3]
    assert ids(search="BUG", start=6) == [3]
    assert ids(limit=1) == [1]


def test_context_breakdown_scales_down(spark):
    ms = messages(spark, user(1), reply(2, input_tokens=10, output_tokens=1, provider_id="p", model_id="m"))
    ps = parts(spark, part(10, 1, "text", text="x" * 40), part(20, 2, "text", text="y" * 40))
    got = {r.key: (r.tokens, r.percent) for r in M.context_breakdown(ms, ps).collect()}
    assert got == {"user": (5, 50.0), "assistant": (5, 50.0)}
