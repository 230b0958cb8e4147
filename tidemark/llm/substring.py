"""Substring dedup by words: remove what repeats 50 words or more of an earlier document.

Difference-cover anchors: stretches of 20 words are hashed only where the word's
number modulo 31 lies in a difference cover. For any two places i and j there is a
shift of at most 30 with both i + shift and j + shift in the cover, so two equal
windows of 50 words share an anchor at the same shift, wherever they stand. Around
each shared anchor the match is extended word by word in both directions: all
windows that hold it are compared as sequences of 50 word hashes, two independent
64-bit hashes each; windows in a row add up to the longest match.

Defined results: words are runs of other characters than ASCII white space, a null or
empty text has none; documents of fewer words than a window are kept as they are;
the smaller ``doc_id`` is earlier, null before all, and rows with one id never remove
from each other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import mix64
from tidemark.llm.repeats import Method, _slices, covered, expand, prefix_hashes, stretch_hashes, with_spans

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31: every difference occurs once.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each row (one more at the end)."""
    inside = np.zeros(len(flat) + 1, bool)
    inside[:-1] = ~_SPACE[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(flat)]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    # A word ends where the next byte is outside or begins a row.
    over = inside.copy()
    over[:-1] &= ~inside[1:] | begins[1:]
    return start, np.flatnonzero(over) + 1, np.searchsorted(start, at)


def word_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    sums = prefix_hashes(flat.astype(np.uint64) + np.uint64(1), base)
    return mix64(stretch_hashes(sums, start, end, base))


def _anchors(flat: np.ndarray, at: np.ndarray):
    start, end, rows = word_bounds(flat, at)
    sums = prefix_hashes(word_hashes(flat, start, end))
    count = np.diff(rows)
    row = np.repeat(np.arange(len(count)), count)
    local = np.arange(len(start)) - rows[row]
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    word = np.flatnonzero(cover[local % PERIOD] & (local + ANCHOR <= count[row]) & (count[row] >= WINDOW))
    mark = mix64(stretch_hashes(sums, word, word + ANCHOR)).view(np.int64)
    place, most = local[word], count[row[word]]
    return row[word], np.maximum(0, place - PERIOD + 1), np.minimum(place, most - WINDOW), mark


def _cutter(flat: np.ndarray, at: np.ndarray):
    start, end, rows = word_bounds(flat, at)
    data = flat.tobytes()
    return lambda row, first, last: b" ".join(data[start[rows[row] + first] : end[rows[row] + last + WINDOW - 1]].split())


def _windows(pieces: list[bytes]):
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    start, end, rows = word_bounds(flat, at)
    count = np.maximum(0, np.diff(rows) - WINDOW + 1)
    word = expand(rows[:-1], count)
    piece = np.repeat(np.arange(len(pieces)), count)
    marks = [mix64(stretch_hashes(prefix_hashes(word_hashes(flat, start, end, b), b), word, word + WINDOW, b)).view(np.int64) for b in (0, 1)]
    return piece, word - rows[piece], *marks


def _compare(pieces: list[bytes], least: np.ndarray, bucket: np.ndarray):
    piece, window, h1, h2 = _windows(pieces)
    order = np.lexsort((h2, h1, bucket[piece]))
    b, x, y, who = bucket[piece[order]], h1[order], h2[order], least[piece[order]]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    lowest = np.minimum.reduceat(who, np.flatnonzero(new)) if len(who) else who
    dead = np.zeros(len(order), bool)
    dead[order] = lowest[np.cumsum(new) - 1] < who
    return window_runs(piece[dead], window[dead])


def window_runs(piece: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in order as piece, first and last of each run; there may be none."""
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(piece))[: len(start)] - 1
    return piece[start], window[start], window[end]


METHOD = Method(_anchors, _cutter, _compare, _windows, block=128, hot=2000)

_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, and ``kept``, the words left with one space between (or its SHA-256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in _slices(batches, "text"):
            start, end, rows = word_bounds(flat, at)
            count = np.diff(rows)
            dead = covered(batch, rows[:-1], count, WINDOW)
            data, kept = flat.tobytes(), []
            for i in range(len(count)):
                words = data[at[i] : at[i + 1]].split()
                gone = dead[rows[i] : rows[i + 1]]
                if gone.any():
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                text = b" ".join(words)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            total = np.concatenate([[0], np.cumsum(dead)])
            gone = total[rows[1:]] - total[rows[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return with_spans(rows, METHOD).mapInArrow(run, _RESULT)
