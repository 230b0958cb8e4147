"""Near-duplicate documents by SimHash fingerprints and Golay-code keys.

Distinct fingerprints are cut into three segments. Two that differ in at most two
bits agree in at least one segment (pigeonhole), and in another one they differ in
at most two bits. The words of 23 bits around a segment (itself and one flipped bit
each) are decoded to codewords of the perfect Golay code: one or six different ones.
Two segments at distance two or less have a word in common, so a codeword too. A
fingerprint's keys are (segment that agrees, another segment's codeword), and only
fingerprints that share a key with a different one go on.

Those are verified without making pairs: two fingerprints differ in at most two bits
exactly if some value is within one bit of both, so each one is hung on the smallest
fingerprint around each such value. Links then go to connected components.

Copies share a fingerprint and are one node, whatever their number. All counts are
combined before the shuffle.

Defined results: a null or empty text has no shingle, and fingerprint zero like any
other text without words; a text of fewer words than a shingle is one shingle; rows
that repeat get the same row each; ids that are null count as smallest and stay null
in ``doc_id`` (a component whose smallest id is null has a null ``component_id``);
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, flat_bytes, id_key, row_slices, stored
from tidemark.llm.components import components

#: Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Widths of the segments of a fingerprint; each is at most 23.
SEGMENTS = (22, 21, 21)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of words of 23 bits by the generator."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


def _errors() -> np.ndarray:
    """For each syndrome the one error pattern of at most three bits: every word has one codeword that near."""
    bits = 1 << np.arange(23)
    two = (bits[:, None] | bits[None, :]).ravel()
    three = (two[:, None] | bits[None, :]).ravel()
    patterns = np.unique(np.concatenate([[0], three]))
    table = np.zeros(2048, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


ERRORS = _errors()


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of 23 bits: row numbers and the different codeword indices (12 bits) around each."""
    near = words.astype(np.int64)[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    index = np.sort((near ^ ERRORS[_syndromes(near)]) >> 11, axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
    return np.nonzero(new)[0], index[new]


def text_fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits over the XXH64 values of a text's word shingles, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    view = memoryview(joined)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    spans = list(zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()))
    for at in range(0, len(spans), 65536):
        hashes = np.array([digest(view[a:b], 42) for a, b in spans[at : at + 65536]], np.uint64)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``row`` (hash of the text) and ``fingerprint`` (a long with the 64 bits) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = flat_bytes(batch.column(2))
            data = flat.tobytes()
            prints = [text_fingerprint(data[a:b], shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "row", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fingerprint long")


def keys(prints: DataFrame) -> DataFrame:
    """``fingerprint`` and its keys: two longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = [64 - sum(SEGMENTS[: i + 1]) for i in range(3)]
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for start, end in row_slices(np.ones(len(whole)), 4096):
                part = whole[start:end]
                segment = [((part.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(shifts, SEGMENTS)]
                for same in range(3):
                    other = (same + 1) % 3
                    row, code = golay_keys(segment[other])
                    yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(segment[same][row] << 16 | code << 2 | same)], names=["fingerprint", "key"])

    return prints.select("fingerprint").mapInArrow(run, "fingerprint long, key long")


def links(prints: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that connect exactly the distinct fingerprints of ``prints`` that are linked through steps of at most two bits."""
    keyed = keys(prints)
    shared = keyed.groupBy("key").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).where("low <> high").select("key")
    # Spark takes what was multiplied for as small as what it came from, and would broadcast it.
    candidates = keyed.join(shared.hint("merge"), "key", "left_semi").select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    around = candidates.withColumn("flip", F.explode(flips)).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("middle"))
    low = around.groupBy("middle").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).where("low <> high").select("middle", "low")
    return around.join(low.hint("merge"), "middle").where("fingerprint <> low").select(F.col("fingerprint").alias("a"), F.col("low").alias("b")).distinct()


def groups(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``docs``, and per distinct one: ``fingerprint``, ``first`` (smallest id) and ``root`` (one of its group)."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(id_key("doc_id")).alias("first")), "distinct-fingerprints")
    roots = components(links(distinct))
    grouped = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left")
    return prints, grouped.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest ``doc_id`` of its group."""
    prints, grouped = groups(docs, shingle)
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("fingerprint", "component_id")
    component = F.when(F.col("component_id") != NULL_ID, F.col("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``docs`` with one row of each ``root`` in ``grouped`` (``key``, ``row``: hash of the text, ``root``): the first by id and text hash."""
    firsts = grouped.groupBy("root").agg(F.min(F.struct("key", "row")).alias("at")).select("at.key", "at.row").distinct()
    keyed = docs.select(id_key("doc_id").alias("key"), F.xxhash64("text").alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    keyed = keyed.join(firsts.hint("merge"), ["key", "row"], "left_semi")
    # Of equal rows with different other columns always the same one stays.
    hashed = F.xxhash64(*[F.col("r")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    return keyed.groupBy("key", "row").agg(F.min_by("r", hashed).alias("r")).select("r.*")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the first by ``doc_id`` (null ids first) and the text's hash. Same columns."""
    prints, grouped = groups(docs.select("doc_id", "text"), shingle)
    rows = prints.join(grouped, "fingerprint").select(id_key("doc_id").alias("key"), "row", "root")
    return first_rows(docs, rows)
