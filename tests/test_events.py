"""Event logs, project statistics, sources and sinks."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.extend import FunctionRegistry, Hooks
from tidemark.operators import eventlog as E
from tidemark.operators import project as P
from tidemark.sources import corpus, documents, entities, logs, requests, tables

LOG = "log_id long, seq long, pos long, kind string, entity_key string, data string"


def test_compaction_is_idempotent_and_incremental(spark):
    rows = [
        (1, 1, 0, "part", "part/m/p1", "Hello"), (1, 1, 1, "part", "part/m/p2", "A"), (1, 2, 0, "part", "part/m/p1", "Hello World"),
        (1, 3, 5, "part", "part/m/p2", "B"), (1, 3, 2, "part", "part/m/p2", "late"), (2, 1, 0, "session", "session", "S"),
    ]
    log = spark.createDataFrame(rows, LOG)
    full = E.compact_event_log(log)
    assert {(r.log_id, r.entity_key): r.data for r in full.collect()} == {
        (1, "part/m/p1"): "Hello World", (1, "part/m/p2"): "B", (2, "session"): "S",
    }
    as_set = lambda df: sorted(map(tuple, df.collect()))
    assert as_set(E.compact_event_log(log, full)) == as_set(full)
    assert as_set(E.compact_event_log(log, E.compact_event_log(log.where("seq < 3")))) == as_set(full)


def test_metrics_skip_what_does_not_parse(spark):
    lines = [(1, 0, '_metric:{"a":"1","b":"2"}'), (1, 1, "noise"), (1, 2, "_metric:{bad"), (1, 3, '_metric:{"b":"3"}')]
    got = E.merge_metrics(spark.createDataFrame(lines, "request_id long, pos long, message string"))
    assert got.first()["metrics"] == {"a": "1", "b": "3"}
    traces = spark.createDataFrame([(1, [m for _, _, m in lines])], "id long, logs array<string>")
    got = E.trace_metrics(traces, {"a": F.lit(9), "c": F.lit(None), "status": F.lit(200)})
    assert got.first()["metrics"] == {"status": "200", "a": "1", "b": "3"}


def test_usage_deltas_merge_deeply(spark):
    data = lambda body: f"event: x\ndata: {json.dumps(body)}"
    chunks = [
        (1, 0, data({"message": {"usage": {"input_tokens": 10, "cache_creation": {"ephemeral_5m_input_tokens": 3}}}})),
        (1, 1, "event: ping\ndata: oops"),
        (1, 2, data({"usage": {"output_tokens": 5, "cache_creation": {"ephemeral_1h_input_tokens": 4}}})),
        (1, 3, data({"usage": {"output_tokens": 7}})),
    ]
    schema = "request_id long, seq long, chunk string"
    got = E.merge_usage_deltas(spark.createDataFrame(chunks, schema), "anthropic").first()
    assert tuple(got) == (1, 10, 7, None, None, 3, 4)
    whole = [(1, 0, 'data: {"usageMetadata":{"promptTokenCount":9,"cachedContentTokenCount":4}}'), (1, 1, "data: x")]
    assert tuple(E.merge_usage_deltas(spark.createDataFrame(whole, schema), "google").first()) == (1, 5, 0, 0, 4, None, None)
    done = [(1, 0, data({"response": {"usage": {"input_tokens": 9}}})), (1, 1, 'event: response.completed\ndata: {"response":{"usage":{"input_tokens":8}}}')]
    assert E.merge_usage_deltas(spark.createDataFrame(done, schema), "openai").first()["input_tokens"] == 8


def test_deltas_with_a_repeated_date(spark):
    rows = [("2025-10-29", 1, 10, 20, 30), ("2025-10-30", 2, 15, 25, 40), ("2025-10-30", 3, 14, 30, 44), ("2025-11-02", 4, 20, 30, 50)]
    series = spark.createDataFrame(rows, "date string, row int, first long, second long, total long")
    got = P.download_deltas(series).orderBy("row").collect()
    assert [(r.first_delta, r.second_delta, r.total_delta) for r in got] == [(0, 0, 0), (5, 5, 10), (-1, 5, 4), (6, 0, 6)]


def test_stats_table(spark):
    lines = [
        "# Download Stats", "| Date | A | B | Total |", "| ---------- | --- | --- | --- |",
        "| 2025-06-29 | 18,789 (+0)  | 39,420 (+0) | 58,209 (+0)  |", "| 2025-06-30 | 20,127 (+1,338) | 41,059 (-1,639) | 61,186 |",
    ]
    got = logs.parse_stats_table(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(str(r.date), r["first"], r.second, r.total) for r in got] == [("2025-06-29", 18789, 39420, 58209), ("2025-06-30", 20127, 41059, 61186)]


def test_log_lines(spark):
    lines = ["INFO  2024-01-02T03:04:05 +12ms service=bus type=a.b publishing now", "ERROR 2024-01-02T03:04:06 +0ms boom", "x"]
    got = logs.parse_logs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.level, r.elapsed_ms, r.tags, r.message) for r in got] == [
        ("INFO", 12, {"service": "bus", "type": "a.b"}, "publishing now"), ("ERROR", 0, None, "boom"),
    ]
    assert got[0].ts == datetime(2024, 1, 2, 3, 4, 5)


def test_commits(spark):
    rows = [
        (1, "a" * 12, "ann", "feat: x\n\nbody", ["services/ingest/api/a.py", "services/ingest/b.py", "README.md"]),
        (2, "b" * 12, "bob", "CHORE: x", ["services/ingest/b.py"]), (3, "c" * 12, None, "docs", ["README.md"]), (4, "d" * 12, None, "sdk", ["docs/x"]),
    ]
    commits = spark.createDataFrame(rows, "seq long, hash string, author string, message string, files array<string>")
    kept = P.filter_commits(commits, (("services/ingest/api/", "api"), ("services/", "ingest"), ("docs/", "guide")))
    assert [(r.hash, r.title, r.areas) for r in kept.orderBy("seq").collect()] == [("aaaaaaa", "feat: x", ["api", "ingest"]), ("ddddddd", "sdk", ["guide"])]
    assert [r.line for r in P.changelog_sections(kept, (("ingest", "Data"),)).collect()] == ["## Data", "- feat: x (@ann)", "## Other", "- sdk"]
    team = spark.createDataFrame([("zed",)], "author string")
    assert [tuple(r) for r in P.contributors(commits, team).collect()] == [("ann", "feat: x")]


def test_catalogue_and_rank(spark):
    doc = {
        "p": {"id": "p", "models": {
            "m-1": {"id": "m-1", "name": "M", "cost": {"input": 3, "output": 15, "context_over_200k": {"input": 6}}, "limit": {"context": 200000, "output": 64000}},
            "m-2": {"id": "m-2", "limit": {"context": 1, "input": 2, "output": 3}},
        }}
    }
    got = documents.scan_model_catalogue(spark.createDataFrame([(json.dumps(doc),)], "value string")).orderBy("model_id").collect()
    assert [(r.model_id, r.input_price, r.tier_input_price, r.context_limit, r.input_limit) for r in got] == [
        ("m-1", 3.0, 6.0, 200000, None), ("m-2", None, None, 1, 2),
    ]
    models = spark.createDataFrame([(m,) for m in ("b-latest", "big-1", "a", "top-2", "z", "big-2-latest")], "model_id string")
    assert [r.model_id for r in documents.rank_models(models, ("big", "top")).collect()] == ["top-2", "big-2-latest", "big-1", "b-latest", "z", "a"]


def test_entity_tree(spark, tmp_path):
    for project, session in (("p1", "s1"), ("p2", "s2")):
        folder = tmp_path / "session" / project
        folder.mkdir(parents=True)
        (folder / f"{session}.json").write_text(json.dumps({"id": session, "title": "T", "extra": 1}, indent=2))
    got = entities.scan_entities(spark, str(tmp_path), "session", "id string, title string")
    assert sorted((r.id, list(r.key)) for r in got.collect()) == [("s1", ["p1", "s1"]), ("s2", ["p2", "s2"])]


def test_entity_upsert(spark, tmp_path):
    write = lambda *rows: entities.write_entities(spark.createDataFrame(rows, "id long, v string, updated long"), str(tmp_path), "x", buckets=4)
    write(*[(i, "a", 1) for i in range(20)])
    write((1, "b", 2), (2, "old", 0), (99, "new", 1), (3, "same", 1))
    write((1, "b", 2))
    got = {r.id: r.v for r in entities.read_entities(spark, str(tmp_path), "x").collect()}
    assert len(got) == 21 and (got[1], got[2], got[3], got[99], got[4]) == ("b", "a", "same", "new", "a")


def test_dump_batch_and_stream(spark, tmp_path):
    rows = [("s1", 1, "m", datetime(2024, 1, 2, 3), "q", "r"), ("", 2, "m", datetime(2024, 1, 2, 3), "q", "r"), ("s1", 3, None, datetime(2024, 1, 2, 4), "q", "r")]
    frame = spark.createDataFrame(rows, "session_id string, request_id long, model string, ts timestamp, request string, response string")
    requests.dump_requests(frame, f"{tmp_path}/batch")
    assert [p.name for p in (tmp_path / "batch/data").glob("model=m/yyyy=2024/mm=01/dd=02/hh=03")] == ["hh=03"]
    assert spark.read.json(f"{tmp_path}/batch/data").select("request_id", "response").collect() == [(1, "r")]
    assert "request" not in spark.read.json(f"{tmp_path}/batch/meta").columns
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    requests.dump_request_stream(stream, f"{tmp_path}/stream", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.json(f"{tmp_path}/stream/data").count() == 1


def test_corpus_folder(spark, tmp_path):
    for name in ("a.txt", "sub/b.txt", "sub/deep/c.txt", ".hid/d.txt", "sub/_x/g.txt", ".git/e.txt", "f.md", ".env"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    names = lambda **o: sorted(r.path for r in corpus.scan_corpus(spark, str(tmp_path), **o).collect())
    everything = [".env", ".hid/d.txt", "a.txt", "f.md", "sub/_x/g.txt", "sub/b.txt", "sub/deep/c.txt"]
    assert names() == everything
    assert names(hidden=False) == everything[2:]
    assert names(globs=("*.txt", "!sub/**"), hidden=False) == ["a.txt"]
    assert names(max_depth=1) == [".env", "a.txt", "f.md"]
    row = corpus.scan_corpus(spark, f"file:{tmp_path}/", globs=(".env",)).first()
    assert (row["path"], row["text"]) == (".env", ".env") and row["mtime"] == (tmp_path / ".env").stat().st_mtime_ns // 1_000_000


def test_corpus_paths_below_a_root_that_repeats(spark, tmp_path):
    """A file whose path holds the root's own path again keeps its whole relative path."""
    again = str(tmp_path).lstrip("/")
    for name in ("a.txt", f"x/{again}/a.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert sorted(r.path for r in corpus.scan_corpus(spark, str(tmp_path)).collect()) == ["a.txt", f"x/{again}/a.txt"]


def test_tolerant_lines_and_tables(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"path":"a","n":1}\n{broken\n\n{"path":"b","n":2}\n')
    assert [tuple(r) for r in logs.scan_jsonl_tolerant(spark, str(tmp_path / "x.jsonl"), "path string, n long").collect()] == [("a", 1), ("b", 2)]
    found = tables.scan_tables(spark, "/root/testdata/sf0.001", ("nation", "region"))
    assert found["nation"].count() == 25


def test_frecency(spark):
    day = 86_400_000
    log = spark.createDataFrame([("a", 9 * day), ("a", 10 * day), ("b", 7 * day)], "path string, last_open long")
    assert {r.path: r.score for r in E.frecency(log, 10 * day).collect()} == {"a": 2.0, "b": 0.25}


def test_extension_surface(spark):
    registry = FunctionRegistry(spark)
    registry.register("plus", "a long, b long", "long", lambda a, b: a + b)
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert registry.call(df, "plus", "c").first()["c"] == 3
    assert spark.sql("SELECT plus(4L, 5L) AS x").first()["x"] == 9
    hooks = Hooks()
    hooks.on("h", lambda d: d.withColumn("a", F.col("a") + 1))
    hooks.on("h", lambda d: d.withColumn("a", F.col("a") * 10))
    assert hooks.apply("h", df).first()["a"] == 20
    assert hooks.apply("other", df) is df
