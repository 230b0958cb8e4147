"""Find passages that also start in an earlier document: the steps that word and byte matching share.

A method names anchors: hashes of short stretches, chosen so that any two equal
windows share one. The steps, each a shuffle whose rows are bounded by the text:

1. Anchors of all documents meet by hash, sorted by document id in one streaming
   pass that keeps a bounded number of rows. Those of a single document are dropped.
   The others get a bucket: the smallest document that has the anchor, and the block
   of that document where it stands. An anchor in more than ``hot`` documents gets a
   bucket of its own.
2. Documents meet the list of their shared anchors and are cut into pieces, one for
   each stretch of windows whose anchors go to one bucket.
3. Equal pieces are collapsed to the smallest document that has them, combined before
   the shuffle: whatever another document has of such a piece is a repeat.
4. The different pieces of a bucket are compared window by window by the method. Of
   hot buckets, which hold any number of pieces, the windows meet one by one in a second
   streaming pass instead, so that no task ever holds such a group.
5. Windows found are joined back, gathered by document, and applied to its text.

An anchor's rows are at most one per document, so one hash holds a large share of all
rows only where documents are hardly longer than a window; the pass over them streams.
Steps 1 to 4 are written to the shared folder. Rows with one id count as one
document: they never remove from each other, and each is cut by its own text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, flat_bytes, id_key, released, row_slices, stored

#: Bytes of text that a Python worker handles at once, or one document.
SLICE = 1_000_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prefix_hashes(values: np.ndarray, base: int = 0) -> np.ndarray:
    """Running polynomial sums of unsigned 64-bit values, one longer than these."""
    pw, _ = powers(len(values), base)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pw[: len(values)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of each stretch [start, end), wherever it stands."""
    _, inverse = powers(len(sums), base)
    return (sums[end] - sums[start]) * inverse[start]


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        size, b = max(n, 1 << 19), _BASES[base]
        one = np.ones(1, np.uint64)
        both = (np.full(size - 1, v, np.uint64) for v in (b, pow(b, -1, 1 << 64)))
        _powers[base] = tuple(np.cumprod(np.concatenate([one, v])) for v in both)
    return _powers[base]


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``count[0]`` numbers, then the same from start[1]."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - before, count)


@dataclass(frozen=True)
class Method:
    """How a kind of text is matched."""

    #: (flat, offsets) -> row, first window, last window, hash (int64) of each anchor, in order of row and window.
    anchors: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: (flat, offsets) -> function of (row, first window, last window) that gives the bytes of these windows.
    cutter: Callable[[np.ndarray, np.ndarray], Callable[[int, int, int], bytes]]
    #: (pieces, smallest id of each, number of the bucket of each) -> piece, first, last window (in the piece) that a smaller id has too.
    compare: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: (pieces) -> piece, window, two hashes (int64) of every window.
    windows: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: Units in a block, and documents from which an anchor is hot.
    block: int
    hot: int


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        flat, at = flat_bytes(batch.column(column))
        for start, end in row_slices(np.diff(at), SLICE):
            yield batch.slice(start, end - start), flat[at[start] : at[end]], at[start : end + 1] - at[start]


def anchor_rows(docs: DataFrame, method: Method) -> DataFrame:
    """``hash``, ``key``, ``row``, ``at``: each anchor once for each row, with its first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in _slices(batches, "text"):
            row, first, _, mark = method.anchors(flat, at)
            order = np.lexsort((first, mark, row))
            row, first, mark = row[order], first[order], mark[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
            ids = [pa.array(batch.column(n).to_numpy(zero_copy_only=False)[row[new]]) for n in ("key", "row")]
            yield pa.RecordBatch.from_arrays([pa.array(mark[new]), *ids, pa.array(first[new].astype(np.int32))], names=["hash", "key", "row", "at"])

    return docs.select("key", "row", "text").mapInArrow(run, "hash long, key long, row long, at int")


def shared_anchors(anchors: DataFrame, method: Method) -> DataFrame:
    """``key``, ``row``, ``hash``, ``a``, ``b``: the anchors that stand in several documents, with their bucket (hot: ``b`` is -1)."""

    def emit(h: np.ndarray, k: np.ndarray, r: np.ndarray, at: np.ndarray, hot: bool = False) -> pa.RecordBatch:
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(h)))
        a, b = np.repeat(k[start], count), np.repeat(at[start] // method.block, count)
        other = new.copy()
        other[1:] |= k[1:] != k[:-1]
        keep = np.repeat(np.add.reduceat(other, start, dtype=np.int64) > 1, count) | hot
        many = np.repeat(count > method.hot, count) | hot
        a, b = np.where(many, h, a), np.where(many, -1, b)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k, r, h, a, b.astype(np.int32))], names=["key", "row", "hash", "a", "b"])

    def fresh(x: list[np.ndarray], before: tuple | None = None) -> list[np.ndarray]:
        """Rows of one id and text come once."""
        new = np.ones(len(x[0]), bool)
        new[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]) | (x[2][1:] != x[2][:-1])
        if before is not None and len(new):
            new[0] = before != (x[0][0], x[1][0], x[2][0])
        return [v[new] for v in x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        known = None  # the hash, and the last id and row, of a hot group that goes on
        for batch in chain(batches, [None]):
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                if known is not None:
                    more = int(np.searchsorted(new[0], known[0], side="right"))
                    front, new = [x[:more] for x in new], [x[more:] for x in new]
                    if more:
                        once = fresh(front, known)
                        if len(once[0]):
                            yield emit(*once, hot=True)
                        known = (front[0][-1], front[1][-1], front[2][-1])
                    if len(new[0]):
                        known = None
                rest = [np.concatenate([x, y]) for x, y in zip(rest, new)]
                if not len(rest[0]):
                    continue
                rest = fresh(rest)
                last = int(np.searchsorted(rest[0], rest[0][-1]))
            else:
                last = len(rest[0])
            if last:
                yield emit(*[x[:last] for x in rest])
            rest = [x[last:] for x in rest]
            if len(rest[0]) > method.hot:
                known = (rest[0][-1], rest[1][-1], rest[2][-1])
                yield emit(*rest, hot=True)
                rest = [x[:0] for x in rest]

    met = anchors.repartition("hash").sortWithinPartitions("hash", "key", "row", "at")
    return met.mapInArrow(run, "key long, row long, hash long, a long, b int")


_PIECE = "a long, b int, id1 long, id2 long, text binary, key long, row long, first int, windows int"


def cut_pieces(docs: DataFrame, shared: DataFrame, method: Method) -> DataFrame:
    """The pieces of every document: bucket (``a``, ``b``), two hashes, text, ``key`` and ``row`` of the document, ``first`` window and number of ``windows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in _slices(batches, "text"):
            found = batch.column("found").flatten()
            table = {n: found.field(n).to_numpy(zero_copy_only=False) for n in ("hash", "a", "b")}
            hashes, index = np.unique(table["hash"], return_index=True)
            row, first, last, mark = method.anchors(flat, at)
            place = np.minimum(np.searchsorted(hashes, mark), len(hashes) - 1)
            hit = hashes[place] == mark
            row, first, last, place = row[hit], first[hit], last[hit], index[place[hit]]
            a, b = table["a"][place], table["b"][place]
            joins = np.zeros(len(row), bool)
            joins[1:] = (row[1:] == row[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (b[1:] >= 0) & (first[1:] <= last[:-1] + 1)
            start = np.flatnonzero(~joins)
            end = np.append(start[1:], len(row)) - 1
            cut = method.cutter(flat, at)
            texts = [cut(*x) for x in zip(row[start].tolist(), first[start].tolist(), last[end].tolist())]
            keys, rows = (batch.column(n).to_numpy(zero_copy_only=False)[row[start]] for n in ("key", "row"))
            ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t, int(y) & (1 << 63) - 1) for t, y in zip(texts, a[start] ^ b[start])), np.int64).reshape(-1, 2)
            columns = [a[start], b[start], ids[:, 0], ids[:, 1], texts, keys, rows, first[start].astype(np.int32), (last[end] - first[start] + 1).astype(np.int32)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _PIECE.split(", ")])

    # By row: many rows may have one id, or none.
    lists = shared.groupBy("key", "row").agg(F.collect_list(F.struct("hash", "a", "b")).alias("found"))
    return docs.join(lists.hint("merge"), ["key", "row"]).select("key", "row", "text", "found").mapInArrow(run, _PIECE)


def compared(distinct: DataFrame, method: Method) -> DataFrame:
    """``id1``, ``id2``, ``spans``: for the smallest document of a piece, the windows that a still smaller one has."""

    def verdict(parts: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(parts)
        a, b, id1, id2, least = (table.column(n).to_numpy() for n in ("a", "b", "id1", "id2", "least"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        bucket = np.cumsum(new) - 1
        # The only piece of a bucket has no other to repeat.
        some = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
        if not len(some):
            return _spans(some, some, some, id1, id2)
        texts = table.column("text").take(pa.array(some)).to_pylist()
        piece, first, last = method.compare(texts, least[some], bucket[some])
        return _spans(some[piece], first, last, id1, id2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            # What is held ends with the last whole bucket; a bucket is bounded by the method.
            same = np.ones(batch.num_rows, bool)
            for n in ("a", "b"):
                values = batch.column(n).to_numpy(zero_copy_only=False)
                before = held[-1].column(n)[-1].as_py() if held else values[0]
                same &= np.concatenate([[before], values[:-1]]) == values
            sizes = np.diff(flat_bytes(batch.column("text"))[1])
            start = 0
            for i in np.flatnonzero(~same).tolist() + [batch.num_rows]:
                size += int(sizes[start:i].sum())
                held.append(pa.Table.from_batches([batch.slice(start, i - start)]))
                start = i
                if size >= SLICE and i < batch.num_rows:
                    yield verdict(held)
                    held, size = [], 0
        if size:
            yield verdict(held)

    sorted_ = distinct.where("b >= 0").repartition("a", "b").sortWithinPartitions("a", "b", "id1", "id2")
    return sorted_.mapInArrow(run, "id1 long, id2 long, spans array<struct<first:int,last:int>>")


def _spans(piece: np.ndarray, first: np.ndarray, last: np.ndarray, id1: np.ndarray, id2: np.ndarray) -> pa.RecordBatch:
    which, count = np.unique(piece, return_counts=True)
    pairs = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["first", "last"])
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pairs)
    return pa.RecordBatch.from_arrays([pa.array(id1[which]), pa.array(id2[which]), spans], names=["id1", "id2", "spans"])


def compared_hot(distinct: DataFrame, method: Method) -> DataFrame:
    """The same for pieces of hot anchors: their windows meet one by one, sorted, in a streaming pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in _slices(batches, "text"):
            piece, window, w1, w2 = method.windows(batch.column("text").to_pylist())
            rest = [batch.column(n).to_numpy(zero_copy_only=False)[piece] for n in ("id1", "id2", "least")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, *rest, window.astype(np.int32))], names=["w1", "w2", "id1", "id2", "least", "window"])

    def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last window, and its smallest id
        for batch in batches:
            w1, w2, least = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("w1", "w2", "least"))
            new = np.ones(len(w1), bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            start = np.flatnonzero(new)
            low = least[start]
            if len(low):
                if before is not None and before[:2] == (w1[0], w2[0]):
                    low[0] = before[2]
                before = (w1[-1], w2[-1], low[-1])
            found = least == np.repeat(low, np.diff(np.append(start, len(w1))))
            yield batch.select(["id1", "id2", "window"]).filter(pa.array(found))

    windows = distinct.where("b < 0").select("id1", "id2", "text", "least").mapInArrow(run, "w1 long, w2 long, id1 long, id2 long, least long, window int")
    met = windows.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "least")
    # What comes back are first places, of which there are no more than different windows; a piece has few windows.
    first = met.mapInArrow(earliest, "id1 long, id2 long, window int").groupBy("id1", "id2").agg(F.collect_list("window").alias("alive"))
    all_ = F.sequence(F.lit(0), F.col("windows") - 1)
    dead = F.transform(F.when(F.col("alive").isNull(), all_).otherwise(F.array_except(all_, "alive")), lambda w: F.struct(w.alias("first"), w.alias("last")))
    return distinct.where("b < 0").select("id1", "id2", "windows").join(first.hint("merge"), ["id1", "id2"], "left").select("id1", "id2", dead.alias("spans"))


def repeated_windows(docs: DataFrame, method: Method) -> DataFrame:
    """``key``, ``row``, ``spans``: ranges of windows of each document that also start in a document with a smaller key.

    ``docs`` has ``key`` (long), ``row`` (long, tells rows of one key apart) and ``text``.
    """
    shared = released(stored(shared_anchors(anchor_rows(docs, method), method), "shared-anchors"))
    pieces = released(stored(cut_pieces(docs, shared, method), "pieces"))
    discard(shared)
    distinct = pieces.groupBy("id1", "id2", "a", "b", "text").agg(F.min("key").alias("least"), F.max("windows").alias("windows"))
    distinct = released(stored(distinct, "distinct-pieces"))
    cold = released(stored(compared(distinct, method), "compared"))
    hot = released(stored(compared_hot(distinct, method), "compared-hot"))
    verdicts = cold.unionByName(hot)
    ids = ["id1", "id2"]
    known = distinct.select(*ids, "least").join(verdicts.hint("merge"), ids, "left")
    places = pieces.select(*ids, "key", "row", "first", "windows").join(known.hint("merge"), ids)
    whole = F.array(F.struct(F.col("first"), (F.col("first") + F.col("windows") - 1).alias("last")))
    shifted = F.transform("spans", lambda s: F.struct((s["first"] + F.col("first")).alias("first"), (s["last"] + F.col("first")).alias("last")))
    places = places.select("key", "row", F.when(F.col("key") > F.col("least"), whole).otherwise(shifted).alias("spans")).where("spans IS NOT NULL")
    spans = stored(places.groupBy("key", "row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeats")
    discard(pieces, distinct, cold, hot)
    del pieces, distinct, cold, hot, verdicts, known, places
    return released(spans)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key`` and ``row``."""
    return docs.select(id_key("doc_id").alias("key"), F.xxhash64("text").alias("row"), "doc_id", F.col("text").cast("string").alias("text"))


def with_spans(docs: DataFrame, method: Method) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` (null: none) of every row of ``docs``."""
    rows = keyed(docs)
    spans = repeated_windows(rows.select("key", "row", "text"), method)
    return rows.join(spans.hint("merge"), ["key", "row"], "left").select("doc_id", "text", "spans")


def covered(batch: pa.RecordBatch, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which units the ``spans`` of a batch cover; ``starts`` and ``counts``: each row's units in one long line."""
    spans = batch.column("spans")
    lengths = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(lengths)), lengths)
    change = np.zeros(int(counts.sum()) + 1, np.int32)
    np.add.at(change, starts[row] + flat.field("first").to_numpy(zero_copy_only=False), 1)
    np.add.at(change, starts[row] + flat.field("last").to_numpy(zero_copy_only=False) + window, -1)
    return np.cumsum(change[:-1]) > 0
