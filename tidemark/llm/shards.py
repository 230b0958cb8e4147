"""Sharding by an external shuffle in two passes.

Pass one scatters the rows by a seeded hash of their number into buckets that fit in
memory: a bucket is as likely for a row as any other, whatever the row holds, so equal
texts, equal ids and long texts spread alike. Pass two takes one bucket at a time, brings
it into the order of the row numbers, shuffles it by Fisher-Yates with a seed of its own,
and writes it. Buckets laid end to end are one random order of all rows.

A row's shard follows from one of three laws:

``rows``   shards are equal stretches of that order: counts are at most one apart
``bytes``  shards are stretches of equal bytes: sizes differ by less than two rows
``key``    the jump consistent hash of ``doc_id``: one more shard takes rows only into
           itself; every bucket is of one shard then

What a bucket needs of the others is how many rows and bytes come before it. That is one
small row per bucket, made by a first narrow scan and joined to its bucket. Rows are
numbered as they stand in the files, so both scans, and a task that runs again, number
alike; a bucket that holds other rows than were counted stops the job. Give tables whose
row order is not fixed (the result of a join, say) as written tables.

Defined results: a null text has no bytes and is one row like any other; a null
``doc_id`` is an id of its own for ``key``, which puts all its rows into one shard, as
equal ids must be; repeated rows are placed each; a text longer than a bucket's bytes
makes that bucket larger, by itself; an empty table gives no rows and an empty folder
with its schema; other columns stay as they are, those named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import folded, id_key, unfolded

LAWS = ("rows", "bytes", "key")


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of ``key`` (a long) by jump consistent hashing: of the shards a key ever moves to, the last below ``shards``.

    Shard s takes the key from the earlier ones with a probability of 1 / (s + 1), by a
    hash of both; a key moves only into the newest shard.
    """
    takes = F.filter(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: (s == 0) | (F.pmod(F.xxhash64(key, s.cast("long")), F.lit(1 << 52)).cast("double") * (s + 1) < F.lit(float(1 << 52))),
    )
    return F.array_max(takes)


def _scattered(docs: DataFrame, buckets: int, shards: int, law: str, seed: int) -> DataFrame:
    """Rows with their number, size and bucket; for ``key``, bucket b is of shard b mod ``shards``."""
    rows = folded(docs, "doc_id", "text").withColumn("number", F.monotonically_increasing_id())
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    draw = F.xxhash64(F.lit(seed), "number")
    if law == "key":
        draw = F.pmod(draw, F.lit(buckets // shards)) * shards + jump_shard(id_key("doc_id"), shards)
    return rows.withColumn("bucket", F.pmod(draw, F.lit(buckets)).cast("long"))


def _bases(counted: DataFrame, law: str, shards: int) -> DataFrame:
    """Per bucket: its ``rows``, and ``rows_before`` and ``bytes_before`` it, in all and in its shard.

    One row per bucket is ordered in one task; the rows of the table are summed before.
    """
    sums = counted.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    group = F.pmod("bucket", F.lit(shards)) if law == "key" else F.lit(0)
    order = Window.partitionBy(group).orderBy("bucket")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    return sums.select(
        "bucket",
        "rows",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("rows").over(everything).alias("all_rows"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A random order of 0 .. n - 1: each place from the last on is swapped with one up to itself."""
    order = np.arange(n)
    if n > 1:
        draws = np.random.default_rng(seed).integers(0, np.arange(n, 1, -1))
        items = order.tolist()
        for place, other in zip(range(n - 1, 0, -1), draws.tolist()):
            items[place], items[other] = items[other], items[place]
        order = np.array(items)
    return order


def _placed(scattered: DataFrame, bases: DataFrame, shards: int, law: str, seed: int) -> DataFrame:
    """The scattered rows with ``shard`` and ``slot`` (by bytes: the place in the whole order), one bucket at a time in memory."""

    def shuffle(rows: pa.Table, base: pa.Table) -> pa.Table:
        bucket, counted, rows_before, bytes_before, all_rows, all_bytes = (int(base.column(i)[0].as_py()) for i in range(6)) if len(base) else (0,) * 6
        if len(rows) != counted:
            raise ValueError(f"bucket {bucket} holds {len(rows)} rows, {counted} were counted: the table's row order is not fixed; write it first")
        fixed = np.argsort(rows.column("number").to_numpy(), kind="stable")
        rows = rows.take(pa.array(fixed[fisher_yates(len(rows), (seed, bucket))]))
        place = rows_before + np.arange(len(rows))
        if law == "rows":
            shard = place * shards // all_rows
            slot = place + -shard * all_rows // shards  # less the first place of the shard
        elif law == "bytes":
            sizes = rows.column("size").to_numpy()
            middle = 2 * (bytes_before + np.cumsum(sizes)) - sizes
            shard, slot = middle * shards // (2 * all_bytes), place
        else:
            shard, slot = np.full(len(rows), bucket % shards), place
        at = [("shard", pa.array(shard, pa.int32())), ("slot", pa.array(slot, pa.int64()))]
        return pa.table({**{c: rows.column(c) for c in rows.column_names}, **dict(at)})

    schema = scattered.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).schema
    # As many tasks as the session's shuffles have: each takes its buckets one after the other.
    return scattered.groupBy("bucket").cogroup(bases.groupBy("bucket")).applyInArrow(shuffle, schema)


def write_shards(docs: DataFrame, path: str, shards: int = 8, law: str = "rows", seed: int = 13, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Write ``docs`` as Parquet to ``path``/shard=0 .. and return what was written.

    The columns are those of ``docs``, and ``size`` (bytes of the text, and one),
    ``law``, ``shard``, ``slot`` (from 0 without gaps in each shard) and ``grown_shard``,
    the shard with one shard more (``key``; else null). Files hold their rows in slot order;
    by bytes, the slots in the files go on from shard to shard.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {', '.join(LAWS)}")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    buckets = -(-max(1, total // bucket_bytes) // shards) * shards
    scattered = _scattered(docs, buckets, shards, law, seed)
    placed = _placed(scattered, _bases(scattered.select("bucket", "size"), law, shards), shards, law, seed)
    grown = jump_shard(id_key("doc_id"), shards + 1) if law == "key" else F.lit(None).cast("int")
    new = {"size": F.col("size"), "law": F.lit(law), "shard": F.col("shard"), "slot": F.col("slot"), "grown_shard": grown}
    rows = unfolded(placed, docs.columns, ("doc_id", "text"), **new)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.schema(rows.schema).parquet(path)
    columns = [f"`{c}`" for c in rows.columns]
    if law != "bytes":
        return back.select(columns)
    # The first place of a shard is known once all are written: one row a shard.
    firsts = F.broadcast(back.groupBy("shard").agg(F.min("slot").alias("_first")))
    return back.join(firsts, "shard").withColumn("slot", F.col("slot") - F.col("_first")).select(columns)
