"""Token ids in a binary format: adaptive context mixing and a range coder, in blocks.

A file is a row of blocks, a block holds whole documents. Blocks know nothing of each
other: the model starts anew in each, and checksums over its bytes and over its ids tell
whether it was read right. A block's ids are cut into lanes that are coded side by side with one
model, as array operations: a step codes the next id of every lane.

The model mixes three predictions of an id: its share among the ids so far (order 0),
the id that last followed the one before (order 1) and the two before (order 2). The
last two get the weight that predictions of the same confidence have earned in this
block. The mixed interval drives a carryless range coder with 64 bits. Decoding takes
the same steps with the same integer arithmetic, so it sees the same model.

Documents are in ascending ``doc_id`` order, null first, equal ids by the text's hash.
Written by Spark as Parquet files whose rows are blocks, so that failed tasks leave
nothing behind and any file system that Spark knows will do.

Defined results: a null text is empty; every document ends with the end id, so an
empty one has a single id; rows that repeat are written each; an empty table gives no
blocks; other columns are ignored. An executor holds one block at a time: about
``BLOCK`` ids or one document.
"""

from __future__ import annotations

import os
import struct
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, flat_bytes, id_key, mix64, row_slices
from tidemark.session import scratch_dir

BLOCK = 1 << 20
#: Bytes of text that are cut into words at a time (or one document).
STEP = 1 << 21
END_ID = 1

_MAGIC = b"TMB1"
_HEAD = "<4sIQIIIIIII"
_TOTAL, _SHARE = 24, 18  # bits of the mixed and of the order-0 distribution
_TABLE = 1 << 18
_LEVELS = 8
_U = np.uint64
_TOP, _LOW = _U(1 << 48), _U(1 << 40)


class _Model:
    """Shared by both directions; all lanes update it after each step."""

    def __init__(self, vocabulary: int):
        self.size = vocabulary
        self.counts = np.zeros(vocabulary, np.int64)
        self.follow = (np.zeros(vocabulary, np.int64), np.zeros(_TABLE, np.int64))
        self.sure = (np.zeros(vocabulary, np.int64), np.zeros(_TABLE, np.int64))
        self.hits = np.tile(np.array([1, 1, 2, 3, 4, 5, 6, 7]), (2, 1)).astype(np.int64)
        self.tries = np.full((2, _LEVELS), 8, np.int64)
        self.steps, self.fresh = 0, []
        self.share()

    def share(self) -> None:
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.size)
            self.fresh = []
        spread = (1 << _SHARE) - self.size
        each = 1 + self.counts * spread // max(1, int(self.counts.sum()))
        each[0] += (1 << _SHARE) - each.sum()
        self.cum = np.concatenate([[0], np.cumsum(each)])
        self.slots = None

    def predict(self, c1: np.ndarray, c2: np.ndarray) -> None:
        """The predicted ids and the three weights for each lane."""
        self.at = (c1, (c2 * 40503 + c1 * 2654435761) & (_TABLE - 1))
        self.ids = tuple(f[a] for f, a in zip(self.follow, self.at))
        self.level = tuple(s[a] for s, a in zip(self.sure, self.at))
        most = (1 << _TOTAL) - (1 << _TOTAL - 5)
        q = self.hits * 65536 // (self.tries + 1)
        self.m2 = (most * q[1] >> 16)[self.level[1]]
        self.m1 = (most - self.m2) * q[0][self.level[0]] >> 16
        self.m1[self.ids[0] == self.ids[1]] = 0
        self.m0 = (1 << _TOTAL) - self.m1 - self.m2

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.cum[x] * self.m0 >> _SHARE, self.cum[x + 1] * self.m0 >> _SHARE
        one, two = self.ids
        start = low + (one < x) * self.m1 + (two < x) * self.m2
        return start, high - low + (one == x) * self.m1 + (two == x) * self.m2

    def find(self, v: np.ndarray) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.size), np.diff(self.cum))
        rest, found = v.copy(), np.full(len(v), -1)
        for x, mass in zip(self.ids, (self.m1, self.m2)):
            start, width = self.interval(x)
            above = v >= start + width
            rest -= above * mass
            hit = (start <= v) & ~above
            found[hit] = x[hit]
        other = np.flatnonzero(found < 0)
        found[other] = self.slots[((rest[other] + 1 << _SHARE) - 1) // self.m0[other]]
        return found

    def learn(self, x: np.ndarray) -> None:
        for k in (0, 1):
            hit, at = self.ids[k] == x, self.at[k]
            self.hits[k] += np.bincount(self.level[k][hit], minlength=_LEVELS)
            self.tries[k] += np.bincount(self.level[k], minlength=_LEVELS)
            self.follow[k][at] = x
            self.sure[k][at] = np.where(hit, np.minimum(self.level[k] + 1, _LEVELS - 1), 0)
        self.fresh.append(x)
        self.steps += 1
        if self.steps < 4 or self.steps % 16 == 0:
            self.share()


def _settle(low: np.ndarray, wide: np.ndarray) -> Iterator[np.ndarray]:
    """Shift out units until every range is wide enough: yields the lanes that shift, just before they do."""
    at = None
    while True:
        l, w = (low, wide) if at is None else (low[at], wide[at])
        same = (l ^ (l + w)) < _TOP
        go = np.flatnonzero(same | (w < _LOW))
        if not len(go):
            return
        l, w = l[go], w[go]
        w = np.where(same[go], w, (~l + _U(1)) & (_LOW - _U(1)))
        at = go if at is None else at[go]
        yield at
        low[at], wide[at] = l << _U(16), w << _U(16)


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of lanes, units (16 bits) of each lane, all units lane after lane."""
    n = len(ids)
    lanes = max(1, min(4096, n // 256))
    steps = -(-n // lanes)
    lanes = max(1, -(-n // steps)) if n else 1
    model, low, wide = _Model(vocabulary), np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    c1, c2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    who, what = [], []
    turns = np.zeros((lanes, steps), np.int64)  # the last lane may end before
    turns.reshape(-1)[:n] = ids
    turns = np.ascontiguousarray(turns.T)

    for step in range(steps):
        k = lanes if step < n - (lanes - 1) * steps else lanes - 1
        x = turns[step, :k]
        model.predict(c1[:k], c2[:k])
        start, width = model.interval(x)
        part = wide[:k] >> _U(_TOTAL)
        low[:k] += part * start.astype(_U)
        wide[:k] = part * width.astype(_U)
        for at in _settle(low, wide):
            who.append(at)
            what.append((low[at] >> _U(48)).astype(np.uint16))
        model.learn(x)
        c2[:k], c1[:k] = c1[:k], x
    for k in (48, 32, 16, 0):
        who.append(np.arange(lanes))
        what.append((low >> _U(k)).astype(np.uint16))
    lane = np.concatenate(who).astype(np.uint16)  # of 16 bits: sorted by radix
    order = np.argsort(lane, kind="stable")
    return lanes, np.bincount(lane, minlength=lanes).astype("<u4"), np.concatenate(what)[order].astype("<u2")


def decode_ids(n: int, vocabulary: int, lanes: int, counts: np.ndarray, units: np.ndarray) -> np.ndarray:
    steps = -(-n // lanes)
    model, low, wide = _Model(vocabulary), np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    c1, c2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    out = np.zeros(n, np.uint32)
    place = np.cumsum(counts.astype(np.int64)) - counts
    units = units.astype(_U)
    code = np.zeros(lanes, _U)
    for k in range(4):
        code = code << _U(16) | units[place + k]
    place = place + 4
    for step in range(steps):
        at = np.arange(step, n, steps)
        k = len(at)
        model.predict(c1[:k], c2[:k])
        part = wide[:k] >> _U(_TOTAL)
        x = model.find(((code[:k] - low[:k]) // part).astype(np.int64))
        start, width = model.interval(x)
        low[:k] += part * start.astype(_U)
        wide[:k] = part * width.astype(_U)
        for go in _settle(low, wide):
            code[go] = code[go] << _U(16) | units[np.minimum(place[go], len(units) - 1)]
            place[go] += 1
        model.learn(x)
        out[at] = x
        c2[:k], c1[:k] = c1[:k], x
    return out


def write_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: head, documents, units of each lane, units."""
    ids = ids.astype("<u4")
    vocabulary = int(ids.max()) + 1 if len(ids) else 1
    if vocabulary > 1 << 17:
        raise ValueError("ids of more than 17 bits")
    lanes, counts, units = encode_ids(ids, vocabulary)
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes(), 1)
    body = docs + zlib.compress(counts.tobytes(), 1)
    rest = body + units.tobytes()
    head = struct.pack(_HEAD, _MAGIC, len(doc_ids), len(ids), vocabulary, lanes, len(docs), len(body) - len(docs), len(units), zlib.crc32(ids.tobytes()), zlib.crc32(rest))
    return head + rest


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids of each document, all ids of a block; a damaged one is an error."""
    magic, n_docs, n, vocabulary, lanes, docs, counts, n_units, check, whole = struct.unpack_from(_HEAD, block)
    if magic != _MAGIC:
        raise ValueError("not a token block")
    at = struct.calcsize(_HEAD)
    if zlib.crc32(memoryview(block)[at:]) != whole:
        raise ValueError("token block is damaged")
    table = zlib.decompress(block[at : at + docs])
    units = np.frombuffer(block, "<u2", n_units, at + docs + counts)
    ids = decode_ids(n, vocabulary, lanes, np.frombuffer(zlib.decompress(block[at + docs : at + docs + counts]), "<u4"), units)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("token block is damaged")
    return np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, "<u8", n_docs, 8 * n_docs).astype(np.int64), ids


class _Words(dict):
    """Numbers of words; new ones are noted and get numbers from ``first`` on."""

    def __init__(self):
        self.new: list[bytes] = []
        self.first = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.first + len(self.new)
        self.new.append(word)
        return number


class _Pieces:
    """Numbers of pieces of at most 16 bytes, by two 64-bit numbers that hold them and the hash of these, in its order."""

    def __init__(self):
        self.mark, self.a, self.b = (np.zeros(0, _U) for _ in range(3))
        self.number = np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)

    def find(self, mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each, -1 if not known."""
        if not len(self.mark):
            return np.full(len(mark), -1)
        at = np.minimum(np.searchsorted(self.mark, mark), len(self.mark) - 1)
        same = (self.mark[at] == mark) & (self.a[at] == a) & (self.b[at] == b)
        self.met[at[same]] = True
        return np.where(same, self.number[at], -1)

    def add(self, mark: np.ndarray, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        new = np.argsort(mark)
        at = np.searchsorted(self.mark, mark[new])
        self.mark, self.a, self.b, self.number = (np.insert(x, at, y[new]) for x, y in ((self.mark, mark), (self.a, a), (self.b, b), (self.number, number)))
        self.met = np.insert(self.met, at, False)

    def renew(self, most: int) -> np.ndarray:
        """Keep what was met again, if that is at most ``most``, under new numbers from 0: their old ones."""
        keep = self.met if self.met.sum() <= most else np.zeros(len(self.met), bool)
        old = self.number[keep]
        self.mark, self.a, self.b, self.number, self.met = self.mark[keep], self.a[keep], self.b[keep], np.arange(len(old)), np.zeros(len(old), bool)
        return old


#: Classes of bytes: white space, letters, digits, other ASCII signs, and what only the tokenizer itself can cut.
_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[ord("'"), ord("<")]] = _ODD  # short forms ('s) and special tokens (<|...)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)  # the first k bytes of 8
_SHORT = 16  # bytes that two 64-bit numbers hold


def _segments(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, whether kept whole, and number per text of the pieces to encode.

    A word of ASCII letters, digits and signs is cut as the tokenizer would do itself:
    runs of letters, single digits, runs of signs. Any other word stays whole.
    """
    kind = _CLASS[flat]
    filled = kind != _BLANK
    first = np.ones(len(flat), bool)
    first[1:] = ~filled[:-1]
    edge = at[:-1][at[:-1] < len(flat)]
    first[edge] = True
    first &= filled
    turn = kind == _DIGIT
    turn[1:] |= kind[1:] != kind[:-1]
    turn &= filled
    turn |= first
    start, word_start = np.flatnonzero(turn), np.flatnonzero(first)
    whole = np.zeros(len(word_start), bool)
    whole[np.searchsorted(word_start, np.flatnonzero(kind == _ODD), "right") - 1] = True
    word = np.cumsum(first[start]) - 1
    keep = first[start] | ~whole[word]
    start, word = start[keep], word[keep]
    last = np.ones(len(flat), bool)
    last[:-1] = ~filled[1:]
    last[edge[edge > 0] - 1] = True
    end = np.flatnonzero(last & filled)[word] + 1
    same = word[1:] == word[:-1]
    end[:-1][same] = start[1:][same]
    return start, end - start, whole[word], np.diff(np.searchsorted(start, at))


def _distinct(flat: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """For pieces of at most 16 bytes: the rows of the distinct ones, which of them each is, and hash and numbers of the distinct ones.

    Two numbers hold all bytes of a piece, padded with zeros; a zero byte inside could
    only be at the end of a whole word, so whole words with one are not given here.
    """
    padded = np.concatenate([flat, np.zeros(16, np.uint8)])
    wide = lambda raw: np.ndarray((len(flat) + 8,), "<u8", raw.tobytes(), strides=(1,))
    plain, lower = wide(padded), wide(_LOWER[padded])
    head, tail = _HEADS[np.minimum(size, 8)], _HEADS[np.maximum(size, 8) - 8]
    kept, second = np.flatnonzero(whole), np.where(size <= 8, start, start + 8)
    a, b = lower[start], lower[second]
    a[kept], b[kept] = plain[start[kept]], plain[second[kept]]
    a, b = a & head, b & tail
    mark = mix64(a) ^ mix64(b + _U(1))
    found = pa.array(mark).dictionary_encode()
    which = found.indices.to_numpy()
    rows = np.zeros(len(found.dictionary), np.int64)
    rows[which] = np.arange(len(mark))
    if (a[rows][which] != a).any() or (b[rows][which] != b).any():  # two pieces, one hash
        _, rows, which = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True, return_inverse=True)
    return rows, which.ravel(), mark[rows], a[rows], b[rows]


def word_encoder(path: str, most: int = 400_000) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Texts to all their ids and the number of ids of each, for a tokenizer that white space parts.

    Texts are cut into pieces as array operations on their bytes; distinct pieces are
    encoded once and remembered; from about ``most`` on those that were met again stay.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    # Words of lower-case ASCII letters are what its normalizer and its pattern make of them: they need a cut at blanks only.
    letters = Tokenizer.from_file(path)
    letters.normalizer, letters.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()

    closes = np.zeros(tokenizer.get_vocab_size(), bool)
    for word, i in tokenizer.get_vocab().items():
        closes[i] = word.endswith("</w>")

    def apart(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
        return np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(some))

    def joined(some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For single pieces: many go in one text, the last id of each closes a word."""
        groups = [some[at : at + 50] for at in range(0, len(some), 50)]
        for group, made in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(made.ids, np.uint32)
            counts = np.diff(np.flatnonzero(closes[ids]), prepend=-1)
            yield (ids, counts) if len(counts) == len(group) else apart(group)

    def of_letters(some: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        texts = [b" ".join(some[at : at + 50]).decode() for at in range(0, len(some), 50)]
        ids = np.fromiter((i for made in letters.encode_batch_fast(texts, add_special_tokens=False) for i in made.ids), np.uint32)
        counts = np.diff(np.flatnonzero(closes[ids]), prepend=-1)
        yield from [(ids, counts)] if len(counts) == len(some) else joined([w.decode() for w in some])

    def encoded(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all and number of ids of each."""
        simple = np.array([w.isalpha() and w.islower() for w in new])  # of bytes: ASCII letters alone
        plain, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
        text = [new[i].decode() for i in rest]
        # Pieces that are not letters throughout, or stay whole, may be cut further.
        single = np.array([w.lower().isalpha() for w in text], bool)
        one, many = np.flatnonzero(single), np.flatnonzero(~single)
        made = [*of_letters([new[i] for i in plain]), *joined([text[i] for i in one])]
        made += [apart([text[i] for i in many[at : at + 1000]]) for at in range(0, len(many), 1000)]
        ids, counts = (np.concatenate(x) for x in zip(*made))
        order = np.concatenate([plain, rest[one], rest[many]])
        place = np.empty(len(new), np.int64)
        place[order] = np.arange(len(new))
        first = (np.cumsum(counts) - counts)[place]
        counts = counts[place]
        at = np.arange(int(counts.sum())) + np.repeat(first - np.cumsum(counts) + counts, counts)
        return ids[at], counts

    words, pieces, start, count = _Words(), _Pieces(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.zeros(0, np.uint32)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal words, start, count, known
        if len(count) > most:
            old = pieces.renew(most // 2)
            words, first, count = _Words(), start[old], count[old]
            start = np.cumsum(count) - count
            known = known[np.arange(int(count.sum())) + np.repeat(first - start, count)]
        flat, at = flat_bytes(texts)
        place, size, whole, per_text = _segments(flat, at)
        plain, lower = flat.tobytes(), _LOWER[flat].tobytes()

        def cut(rows: np.ndarray) -> list[bytes]:
            some = zip(place[rows].tolist(), (place[rows] + size[rows]).tolist(), whole[rows].tolist())
            return [(plain if w else lower)[i:j] for i, j, w in some]

        fits = (size <= _SHORT) & ~(whole & (flat[place + size - 1] == 0))
        short, other = np.flatnonzero(fits), np.flatnonzero(~fits)
        number = np.zeros(len(place), np.int64)
        rows, which, *keys = _distinct(flat, place[short], size[short], whole[short])
        of = pieces.find(*keys)
        new = np.flatnonzero(of < 0)
        of[new] = len(count) + np.arange(len(new))
        pieces.add(*(k[new] for k in keys), of[new])
        number[short] = of[which]
        words.first, words.new = len(count), cut(short[rows[new]])
        number[other] = [words[w] for w in cut(other)]
        if words.new:
            made, more = encoded(words.new)
            words.new = []
            start = np.concatenate([start, len(known) + np.cumsum(more) - more])
            count = np.concatenate([count, more])
            known = np.concatenate([known, made])
        each = count[number]
        before = np.cumsum(each) - each
        ids = known[np.arange(int(each.sum())) + np.repeat(start[number] - before, each)]
        total = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])

    return encode


def kept_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """The word encoder of this worker process for ``path``, with the words it knows: workers run many tasks.

    Functions reach a worker by value, so what shall outlive a task is kept in a module of the process.
    """
    kept = vars(sys.modules.setdefault("tidemark_kept_encoders", types.ModuleType("tidemark_kept_encoders")))
    if path not in kept:
        kept[path] = word_encoder(path)
    return kept[path]


_BLOCKS = "part int, block int, n_docs int, n_tokens long, payload binary"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Blocks of all documents: ``part`` and ``block`` give their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = block = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, block
            keys, lengths, ids = (np.concatenate(x) for x in zip(*held))
            payload = write_block(keys, lengths, ids)
            row = [[part], [block], [len(keys)], [len(ids)], [payload]]
            held, size, block = [], 0, block + 1
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            keys, texts = batch.column("key").to_numpy(zero_copy_only=False), batch.column("text")
            for at, end in row_slices(np.diff(flat_bytes(texts)[1]), STEP):
                ids, lengths = encode(texts.slice(at, end - at))
                own = keys[at:end]
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                lengths = lengths + 1
                edge = np.concatenate([[0], np.cumsum(lengths)])
                first = 0
                for i in range(len(own)):
                    size += int(lengths[i])
                    if size >= BLOCK or i == len(own) - 1:
                        held.append((own[first : i + 1], lengths[first : i + 1], ids[edge[first] : edge[i + 1]]))
                        first = i + 1
                    if size >= BLOCK:
                        yield flush()
        if held:
            yield flush()

    keyed = docs.select(id_key("doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    order = [F.col("key"), F.xxhash64("text")]  # rows of one id spread too
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, _BLOCKS)


def write_documents(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    encode_documents(docs, tokenizer, end_id).write.parquet(path)


def read_documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (and ``ids``) of every document of the blocks at hand."""
    schema = "part int, block int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(*(batch.column(c) for c in ("part", "block", "payload"))):
                keys, lengths, ids = read_block(payload.as_py())
                edge = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4").tobytes())
                checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                columns = [
                    pa.array(np.full(len(keys), part.as_py(), np.int32)),
                    pa.array(np.full(len(keys), block.as_py(), np.int32)),
                    pa.array(keys, mask=keys == NULL_ID),
                    pa.array(edge[:-1].astype(np.int64)),
                    pa.array(lengths),
                    pa.array(checks, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_tokens")
    # One row per file is added up in one task.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("inside"))
    starts = inside.join(bases, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("base"))
    docs = blocks.select("part", "block", "payload").mapInArrow(run, schema)
    start = (F.col("base") + F.col("local")).alias("start")
    return docs.join(starts, ["part", "block"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids to the shared folder, and what is read back from there."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write_documents(docs, path, tokenizer)
    return read_documents(spark.read.schema(_BLOCKS).parquet(path))
