"""Streams in several micro-batches against their batch twins."""

import random
import weakref
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import eventlog as E
from tidemark.operators import ledger
from tidemark.operators.pending import pending_requests
from tidemark.plans.streams import _permission_events
from tidemark.plans.views import Views
from tidemark.streaming import events as S
from tidemark.streaming import state as K


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The events table cut into five files in time order, one micro-batch each."""
    folder = str(tmp_path_factory.mktemp("events"))
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    size = table.count() // 5 + 1
    for i in range(5):
        part = table.where((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size)).coalesce(1)
        part.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return table, stream


def land(spark, stream, path, last=4):
    query = S.run(stream, f"{path}/out", f"{path}/cp")
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= last
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def rows(df):
    return sorted(map(repr, df.collect()))


def views(spark):
    return Views(spark, "/root/testdata/sf0.001")


def test_rolling_usage(spark, events, tmp_path):
    table, stream = events
    v = views(spark)
    got = land(spark, K.stream_rolling_usage(v.usage(stream), 5), tmp_path)
    want = ledger.rolling_usage(v.usage(table), ["user_id"], 5).select("id", "user_id", "anchor", "rolling_usage")
    assert rows(got) == rows(want)


def test_compaction_and_replay(spark, events, tmp_path):
    table, stream = events
    v = views(spark)
    want = rows(E.compact_event_log(v.event_log(table)).select("log_id", "entity_key", "data", "seq", "pos"))
    root = str(tmp_path)
    for checkpoint in ("cp1", "cp2"):  # the second run replays everything into the same store
        S.stream_compaction(v.event_log(stream), root, f"{root}/{checkpoint}", buckets=4).awaitTermination()
        assert rows(S.compacted(spark, root).select("log_id", "entity_key", "data", "seq", "pos")) == want


def test_hours_by_upsert(spark, events, tmp_path):
    table, stream = events
    v = views(spark)
    root = str(tmp_path)
    S.upsert(S.stream_ip_hours(v.usage(stream)), ["ip", "interval"], root, f"{root}/cp", buckets=4).awaitTermination()
    assert rows(S.upserted(spark, root).select("ip", "interval", "count")) == rows(ledger.hourly_ip_counts(v.usage(table)))


def test_pending(spark, events, tmp_path):
    table, stream = events
    changes = land(spark, K.stream_pending_requests(_permission_events(stream)), tmp_path)
    last = changes.groupBy("session_id", "id").agg(F.max_by("state", F.struct("seq", F.col("state") != "pending")).alias("state"))
    want = pending_requests(_permission_events(table), per_session=True).select("session_id", "id")
    assert rows(last.where("state = 'pending'").select("session_id", "id")) == rows(want)


def test_status(spark, events, tmp_path):
    table, stream = events
    status = F.when(F.col("event_type") == "view", "idle").otherwise(F.col("event_type"))
    shape = lambda df: df.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("pos"), status.alias("status"))
    root = str(tmp_path)
    want = shape(table).groupBy("session_id").agg(F.max_by(F.struct("seq", "pos", "status"), "seq").alias("l")).select("session_id", "l.*").where("status <> 'idle'")
    for checkpoint in ("cp1", "cp2"):  # the second run replays everything
        S.session_status(shape(stream), root, f"{root}/{checkpoint}", buckets=4).awaitTermination()
        assert rows(S.statuses(spark, root)) == rows(want)


def micro_batches(spark, batches, schema, path):
    """A stream that delivers each list of rows as a micro-batch of its own."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_an_older_event_does_not_revive_an_idle_session(spark, tmp_path):
    schema = "session_id long, seq long, pos long, status string"
    batches = [[(1, 1, 0, "busy"), (2, 1, 0, "busy")], [(1, 5, 0, "idle")], [(1, 4, 0, "retry"), (2, 2, 1, "retry"), (2, 2, 0, "busy")]]
    stream = micro_batches(spark, batches, schema, f"{tmp_path}/in")
    S.session_status(stream, f"{tmp_path}/out", f"{tmp_path}/cp", buckets=2).awaitTermination()
    assert [tuple(r) for r in S.statuses(spark, f"{tmp_path}/out").collect()] == [(2, 2, 1, "retry")]


def test_text_comes_together_from_late_deltas(spark, tmp_path):
    schema = "part_id long, seq long, delta string"
    batches = [[(1, 2, "c"), (1, 0, "a")], [(2, 0, "x \n")], [(1, 3, "d "), (1, 1, "b")]]
    stream = micro_batches(spark, batches, schema, f"{tmp_path}/in")
    S.assemble_text(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert rows(S.assembled(spark, f"{tmp_path}/out")) == rows(spark.createDataFrame([(1, "abcd"), (2, "x")], "part_id long, text string"))


def expired(spark, path):
    """Rows left in the state of a finished query."""
    return spark.read.format("statestore").option("path", path).option("stateVarName", "value").load().count()


def test_sticky_choice_expires(spark, tmp_path):
    start = datetime(2024, 1, 1)
    data = [(1, 0, "a"), (2, 20, "b"), (3, 44, "c"), (4, 69, "d"), (5, 70, "e")]
    schema = "id long, session_id long, ts timestamp, provider string"
    batches = [[(id, 7, start + timedelta(hours=hours), provider)] for id, hours, provider in data]
    # Other sessions: one that ends, one that moves time on, and a row behind the watermark.
    batches[0].append((10, 8, start, "z"))
    batches += [[(11, 9, start + timedelta(hours=200), "y")], [(12, 8, start + timedelta(hours=1), "late"), (13, 9, start + timedelta(hours=201), "x")]]
    got = {r.id: r.provider for r in land(spark, K.sticky_choice(micro_batches(spark, batches, schema, f"{tmp_path}/in")), tmp_path).collect()}
    assert got == {1: "a", 2: "a", 3: "a", 4: "d", 5: "d", 10: "z", 11: "y", 13: "y"}
    assert expired(spark, f"{tmp_path}/cp") == 1  # session 9 alone


def test_rolling_usage_ends_with_its_window(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "id long, user_id long, ts timestamp, cost long"
    at = lambda id, user, minutes, cost: (id, user, start + timedelta(minutes=minutes), cost)
    batches = [[at(2, 1, 30, 5), at(1, 1, 0, 7)], [at(3, 1, 60, 1), at(4, 1, 61, 2), at(5, 2, 61, 1)], [at(6, 2, 500, 4)], [at(7, 1, 10, 100), at(8, 2, 501, 1)]]
    stream = micro_batches(spark, batches, schema, f"{tmp_path}/in")
    got = {r.id: r.rolling_usage for r in land(spark, K.stream_rolling_usage(stream, 1, "10 minutes"), tmp_path, 3).collect()}
    assert got == {1: 7, 2: 12, 3: 13, 4: 2, 5: 1, 6: 4, 8: 5}  # row 7 is late
    assert expired(spark, f"{tmp_path}/cp") == 1


def test_append_mode_gives_out_closed_batches(spark, events, tmp_path):
    table, stream = events
    v = views(spark)
    got = land(spark, S.batch_changes(v.event_log(stream)).select("log_id", "entity_key", "seq"), tmp_path)
    assert 0 < got.count() <= table.count()


def test_dangling_and_expired(spark, tmp_path):
    parts = [(1, 10, "tool", "running", None), (2, 10, "tool", "completed", None), (3, 11, "tool", "pending", None), (4, 10, "text", None, None)]
    df = spark.createDataFrame(parts, "id long, message_id long, type string, status string, error string")
    df.write.parquet(f"{tmp_path}/in")
    ended = spark.createDataFrame([(10,)], "message_id long")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    S.run(S.close_dangling(stream, ended), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.id: (r.status, r.error) for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {1: ("error", S.ABORTED), 2: ("completed", None), 3: ("pending", None), 4: (None, None)}
    now = 1_767_225_600_000
    name = lambda days: f"tool_{((now - days * 86_400_000) * 4096 + 1) % (1 << 48):012x}abc"
    files = spark.createDataFrame([(name(3),), (name(10),), (name(7),)], "id string")
    assert sorted(r.id for r in S.expire_outputs(files, now).collect()) == sorted([name(3), name(7)])


@pytest.mark.parametrize("folder", [True, False])
def test_a_streamed_table_may_be_a_folder_of_files(spark, tmp_path, folder):
    table = spark.range(5).selectExpr("id AS part_id", "id AS seq", "'x ' AS delta")
    if folder:
        table.repartition(2).write.parquet(str(tmp_path / "deltas.parquet"))
    else:
        table.toPandas().to_parquet(tmp_path / "deltas.parquet")
    root = str(tmp_path / "out")
    S.assemble_text(Views(spark, str(tmp_path)).stream("deltas"), f"{root}/parts", f"{root}/checkpoint").awaitTermination()
    assert sorted(r.part_id for r in S.assembled(spark, f"{root}/parts").collect()) == [0, 1, 2, 3, 4]


def test_a_session_of_approvals_against_a_plain_loop():
    rng = random.Random(3)
    fits = lambda want, rules: any(K._fits(want[0], a) and K._fits(want[1], b) for a, b in rules)
    session, open_, rules = K._Session([("a", "x9*")]), {}, [("a", "x9*")]
    for n in range(600):
        if rng.random() < 0.7:
            asked = (rng.choice("ab"), [f"x{rng.randrange(12)}" for _ in range(rng.randrange(3))], [])
            session.ask(n, *asked)
            open_[n] = asked
        else:
            new = [(rng.choice("ab"), f"x{rng.randrange(12)}*") for _ in range(2)]
            session.approve(new)
            rules += new
            done = {i for i, (p, wanted, _) in open_.items() if all(fits((p, w), rules) for w in wanted)}
            assert set(session.ready) == done
            for i in done:
                session.drop(i)
                del open_[i]
        if n % 97 == 0:
            rules, session, open_ = [], K._Session([]), {}
    assert set(session.requests) == set(open_)


def test_an_approval_meets_each_pattern_once(monkeypatch):
    calls = []
    monkeypatch.setattr(K, "_fits", lambda text, pattern: calls.append(1) or text == pattern)
    session = K._Session([])
    for n in range(2000):
        session.ask(n, "a", ["x"], [])
        session.approve([("a", "y")])
    assert len(calls) < 10 and len(session.requests) == 2000


EVENT = ["seq", "id", "kind", "permission", "patterns", "always", "reply"]


class _Kept:
    """State of a stream in memory."""

    def __init__(self, *_):
        self.values, self.rules = {}, []

    getMapState = getListState = lambda self, *_: _Kept()

    def iterator(self):
        return iter(self.values.items())

    def updateValue(self, key, value):
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]

    def get(self):
        return iter(self.rules)

    def appendList(self, rules):
        self.rules += rules


def test_pending_holds_few_rows_of_a_large_session():
    n = 120_000
    order = list(range(n))
    random.Random(7).shuffle(order)
    alive, most = weakref.WeakSet(), 0

    class Part(pd.DataFrame):
        __hash__ = object.__hash__

    def parts():
        nonlocal most
        for start in range(0, n, 1000):
            ids = order[start : start + 1000]  # each is asked at 2i; the even ones are answered at 2i + 1
            asked = [(2 * i, i, "asked", "edit", [f"f{i}"], [], None) for i in ids]
            part = Part(asked + [(2 * i + 1, i, "replied", "edit", None, None, "once") for i in ids if i % 2 == 0], columns=EVENT)
            alive.add(part)
            most = max(most, len(alive))
            yield part

    pending = K._Pending()
    pending.init(_Kept())
    got = pd.concat(list(pending.handleInputRows((3,), parts(), None)), ignore_index=True)
    assert most <= 3
    assert got["seq"].is_monotonic_increasing and len(got) == n + n // 2 and set(got["session_id"]) == {3}
    assert sorted(k[0] for k in pending.open.values) == list(range(1, n, 2))
    # The next batch goes on from there: one is asked anew, one is answered, and a rejection ends the others.
    more = pd.DataFrame([(3 * n + 1, 1, "replied", "edit", None, None, "reject"), (3 * n, 0, "asked", "edit", ["x"], [], None)], columns=EVENT)
    got = pd.concat(list(pending.handleInputRows((3,), iter([more]), None)))
    assert got["state"].tolist() == ["pending"] + ["reject"] * (n // 2 + 1) and not pending.open.values
