"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_dir

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Ids that are null sort before all others and equal each other.
NULL_ID = -(2**63)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: the lineage ends in files that outlive executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(conf).delete(path, True)


def released(df: DataFrame) -> DataFrame:
    """``df``, after a hint to drop what no frame refers to: Spark's cleaner deletes shuffle files then, not before."""
    gc.collect()
    df.sparkSession.range(1).collect()  # else the listener bus holds on to the last query
    df.sparkSession._jvm.System.gc()
    return df


def id_key(column: str | Column) -> Column:
    """A document id as a join and sort key without nulls."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID)).cast("long")


def flat_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the offsets of its rows (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def row_slices(sizes: np.ndarray, limit: int):
    """Ranges of rows whose sizes add up to about ``limit``; a larger row stands alone."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
        yield start, end
        start = end


def small_batches(batches: Iterable[pa.RecordBatch], column: int | str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` by about ``limit`` bytes of text at a time, or one row.

    A batch holds 10000 rows whatever their length; all that is made of it would be as large again
    several times, and stay with the worker process for the next stages.
    """
    for batch in batches:
        for start, end in row_slices(np.diff(flat_bytes(batch.column(column))[1]), limit):
            yield batch.slice(start, end - start)
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def folded(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` as the needed columns and ``_rest``, a struct of all others, whose names then clash with nothing."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c not in needed]
    return df.select(*needed, F.struct(F.lit(0).alias("none"), *rest).alias("_rest"))


def unfolded(df: DataFrame, columns: list[str], needed: tuple[str, ...], **new: Column) -> DataFrame:
    """The opposite: ``columns`` in their order, those named in ``new`` computed anew or added at the end."""
    rest = {c: f"c{i}" for i, c in enumerate(columns) if c not in needed}
    old = [new[c] if c in new else F.col("_rest")[rest[c]] if c in rest else F.col(c) for c in columns]
    return df.select(*[v.alias(c) for v, c in zip(old, columns)], *[v.alias(c) for c, v in new.items() if c not in columns])
