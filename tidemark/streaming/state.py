"""Stream operators that keep state per key.

They need the RocksDB state store, see :data:`tidemark.session.ROCKSDB`. A
micro-batch may deliver the rows of a key in any order, so each is sorted first;
what one task holds is the rows of one key in one micro-batch, which
``maxFilesPerTrigger`` or the source's own limit bounds. Permission requests, whose
rows are wide, are sorted through files of the worker instead.

State ends by event time: each key sets a timer for the moment from which its state
no longer matters, and drops the state when the watermark has passed it. Rows older
than the watermark are late and are left out, as in any windowed stream.
"""

from __future__ import annotations

import heapq
import re
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.text import wildcard_literal

STICKY_SECONDS = 86_400


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, ignore_index=True)


class _Expiring(StatefulProcessor):
    """One value per key, and one timer: the state ends when the watermark passes it."""

    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def keep(self, value: tuple, until_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.value.update(value)
        self.handle.registerTimer(until_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Rolling(_Expiring):
    """Anchor second and sum of the open window."""

    schema = "anchor long, used long"

    def __init__(self, width: int):
        self.width = width

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        anchor, used = self.value.get() if self.value.exists() else (None, 0)
        pdf = _sorted(rows, ["micros", "id"])
        seconds, cost = pdf["micros"].to_numpy() // 1_000_000, pdf["cost"].to_numpy()
        anchors, sums = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        at = 0
        while at < len(pdf):  # a step is a window
            if anchor is None or anchor < seconds[at] - self.width:
                anchor, used = int(seconds[at]), 0
            end = int(np.searchsorted(seconds, anchor + self.width, side="right"))
            anchors[at:end] = anchor
            sums[at:end] = used + np.cumsum(cost[at:end])
            used, at = int(sums[end - 1]), end
        self.keep((anchor, used), (anchor + self.width + 1) * 1000)
        yield pd.DataFrame({"id": pdf["id"], "user_id": key[0], "anchor": anchors, "rolling_usage": sums})


def stream_rolling_usage(stream: DataFrame, hours: int, watermark: str = "1 hour") -> DataFrame:
    """Anchored window per user; every row with its anchor and the usage so far."""
    rows = stream.withWatermark("ts", watermark).select("id", "user_id", "ts", F.unix_micros("ts").alias("micros"), "cost")
    return rows.groupBy("user_id").transformWithStateInPandas(
        _Rolling(hours * 3600), "id long, user_id long, anchor long, rolling_usage long", "Append", "EventTime"
    )


class _Sticky(_Expiring):
    """Last provider and when it was used."""

    schema = "provider string, micros long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        provider, used = self.value.get() if self.value.exists() else (None, None)
        pdf = _sorted(rows, ["micros", "id"])
        micros = pdf["micros"].to_numpy()
        fresh = np.diff(micros, prepend=micros[0] if used is None else used) > STICKY_SECONDS * 1_000_000
        fresh[0] |= used is None
        # Each row has the provider of the last fresh one; before the first, that of the state.
        source = np.maximum.accumulate(np.where(fresh, np.arange(len(pdf)), -1))
        chosen = np.where(source < 0, provider, pdf["provider"].to_numpy()[source])
        last = max(int(micros[-1]), used or int(micros[-1]))
        self.keep((chosen[-1], last), last // 1000 + STICKY_SECONDS * 1000 + 1)
        yield pd.DataFrame({"id": pdf["id"], "session_id": key[0], "provider": chosen})


def sticky_choice(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Provider per request: that of the session's last request, if it was within 24 hours."""
    rows = stream.withWatermark("ts", watermark).select("id", "session_id", "ts", F.unix_micros("ts").alias("micros"), "provider")
    return rows.groupBy("session_id").transformWithStateInPandas(
        _Sticky(), "id long, session_id long, provider string", "Append", "EventTime"
    )


@lru_cache(maxsize=4096)
def _matcher(pattern: str) -> re.Pattern:
    # Java writes the end of the text as \z, Python as \Z.
    return re.compile(wildcard_literal(pattern).removesuffix(r"\z") + r"\Z")


def _fits(text: str, pattern: str) -> bool:
    return _matcher(pattern).match(text) is not None


class _Session:
    """Open requests and approved patterns of one session, indexed by what they ask for.

    A request counts its patterns that no rule allows yet. Each (permission, pattern) that is
    asked for meets each rule once, so an ``always`` costs the requests that it lets through,
    not all that are open.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = dict.fromkeys(rules)
        self.allowed: dict[tuple[str, str], bool] = {}
        self.missing: dict[int, int] = {}  # request: patterns not allowed
        self.ready: dict[int, None] = {}  # requests with none, in the order they got there
        self.waiting: dict[tuple[str, str], dict[int, None]] = {}
        self.requests: dict[int, tuple] = {}

    def ask(self, request: int, permission: str, patterns: list[str], always: list[str]) -> None:
        self.drop(request)
        self.requests[request] = (permission, patterns, always)
        self.missing[request] = 0
        for want in dict.fromkeys((permission, p) for p in patterns):
            if want not in self.allowed:
                self.allowed[want] = any(_fits(want[0], a) and _fits(want[1], b) for a, b in self.rules)
            if not self.allowed[want]:
                self.missing[request] += 1
                self.waiting.setdefault(want, {})[request] = None
        if not self.missing[request]:
            self.ready[request] = None

    def drop(self, request: int) -> tuple | None:
        found = self.requests.pop(request, None)
        if found is not None:
            self.ready.pop(request, None)
            self.missing.pop(request)
            for want in {(found[0], p) for p in found[1]}:
                self.waiting.get(want, {}).pop(request, None)
        return found

    def approve(self, rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """The rules that are new; requests that they let through become ready."""
        fresh = [r for r in dict.fromkeys(rules) if r not in self.rules]
        self.rules.update(dict.fromkeys(fresh))
        for want in [w for w, yes in self.allowed.items() if not yes] if fresh else ():
            if any(_fits(want[0], a) and _fits(want[1], b) for a, b in fresh):
                self.allowed[want] = True
                for request in self.waiting.pop(want, {}):
                    self.missing[request] -= 1
                    if not self.missing[request]:
                        self.ready[request] = None
        return fresh


#: Rows of a key that are held at once, and that are read at once of each sorted file.
RUN_ROWS, READ_ROWS = 50_000, 1000

_EVENT = pa.schema(
    [("seq", pa.int64()), ("id", pa.int64()), *[(n, pa.string()) for n in ("kind", "permission")], *[(n, pa.list_(pa.string())) for n in ("patterns", "always")], ("reply", pa.string())]
)


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The events of a key by ``seq``: sorted runs of a fixed number of rows, of which all but the last wait in files."""
    records = lambda batches: (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))

    def run(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).sort_by("seq")

    def filed(table: pa.Table) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()  # has no name, and ends with the worker
        with pa.ipc.new_stream(file, _EVENT) as out:
            out.write_table(table, max_chunksize=READ_ROWS)
        file.seek(0)
        return records(pa.ipc.open_stream(file))

    runs, held, n = [], [_EVENT.empty_table()], 0
    for pdf in rows:
        held.append(pa.Table.from_pandas(pdf[_EVENT.names], _EVENT, preserve_index=False))
        n += len(pdf)
        if n >= RUN_ROWS:
            runs.append(filed(run(held)))
            held, n = [_EVENT.empty_table()], 0
    runs.append(records(run(held).to_batches(READ_ROWS)))
    return heapq.merge(*runs, key=lambda row: row[0])


class _Pending(StatefulProcessor):
    """Open requests and approved patterns of one session; read once and written once in a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "id long", "permission string, patterns array<string>, always array<string>")
        self.approved = handle.getListState("approved", "permission string, pattern string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session = _Session([tuple(r) for r in self.approved.get()])
        for (request,), value in self.open.iterator():
            session.ask(int(request), value[0], list(value[1]), list(value[2]))
        stored, added, out = dict(session.requests), [], []

        def changes() -> pd.DataFrame:
            pdf = pd.DataFrame(out, columns=["id", "seq", "state"])
            pdf.insert(0, "session_id", key[0])
            out.clear()
            return pdf

        for seq, request, kind, permission, patterns, always, reply in _in_order(rows):
            if len(out) >= RUN_ROWS:
                yield changes()
            if kind == "asked":
                session.ask(request, permission, patterns, always)
                out.append((request, seq, "pending"))
                continue
            found = session.drop(request)
            if found is None:
                continue
            out.append((request, seq, reply))
            if reply == "reject":
                out += [(other, seq, "reject") for other in session.requests]
                for other in list(session.requests):
                    session.drop(other)
            elif reply == "always":
                added += session.approve([(found[0], p) for p in found[2]])
                out += [(other, seq, "always") for other in session.ready]
                for other in list(session.ready):
                    session.drop(other)
        for request in stored.keys() - session.requests.keys():
            self.open.removeKey((request,))
        for request, value in session.requests.items():
            if stored.get(request) is not value:  # asked in this batch
                self.open.updateValue((request,), value)
        if added:
            self.approved.appendList(added)
        if out:
            yield changes()

    def close(self) -> None:
        pass


def stream_pending_requests(stream: DataFrame) -> DataFrame:
    """State changes (session_id, id, seq, state); a request is pending while that is its last one."""
    rows = stream.select("session_id", "seq", "kind", "id", "permission", "patterns", "always", "reply")
    return rows.groupBy("session_id").transformWithStateInPandas(
        _Pending(), "session_id long, id long, seq long, state string", "Append", "None"
    )
