"""Running totals over an ordered sequence: a segmented prefix scan over ranges.

A window over a whole key puts all its rows into one task. Here the table is cut into
ranges of about equal numbers of rows, in the order of (keys, order). A range ends
inside at most one key, so only keys that span several ranges are cut at all, and there
are never more cuts than ranges:

1. cuts: a uniform sample of the table, a fixed number of rows for each range, is sorted;
   every ``PER_RANGE``-th of its rows is a cut. The sample is the rows with the smallest
   hashes, so it is the same however often it is taken.
2. local scan: a window over (keys, block), where the block of a row is the number of its
   key's cuts at or before it. This is the one shuffle of the rows.
3. carry: one total per cut key and block, combined before its shuffle, and a window over
   those few rows gives what each block starts from.

Rows with texts and lists are dealt over as many partitions as their values fill, so that
what a task sorts does not grow with the table.

The cuts and the carried totals have at most as many rows as there are ranges, whatever
the table holds; they are broadcast. The plan is the same for every input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled rows for each range.
PER_RANGE = 16
#: Bytes of values for each task of a shuffle of wide rows. Spark sizes its tasks by compressed
#: bytes, and texts that repeat can be a hundred times as large in a sort.
TASK_BYTES = 64 << 20

_AGGREGATES = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    zero = F.lit(0)
    return F.coalesce(before, zero) + F.coalesce(here, zero)


def _joined(df: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``df`` joined to the broadcast rows of ``few`` on equal keys (also null ones), which ``few`` calls _k0, _k1, ..."""
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & df[key].eqNullSafe(few[f"_k{i}"])
    return df.join(F.broadcast(few), same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    if isinstance(kind, T.ArrayType):
        added = F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + _bytes(x, kind.elementType))
        return F.coalesce(added, F.lit(0).cast("long"))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def partitions_for(df: DataFrame) -> int:
    """How many partitions of ``TASK_BYTES`` the values of ``df`` fill, and no fewer than there are cores."""
    total = df.agg(F.sum(_bytes(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)).alias("n")).first()["n"] or 0
    return max(2, df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def _cuts(df: DataFrame, keys: list[str], order: list[str], ranges: int) -> DataFrame:
    """``_cuts``, sorted structs of ``order``, for each key that is cut: fewer than ``ranges`` in all."""
    sampled = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*order).alias("_cut"))
    names = [f"_k{i}" for i in range(len(keys))]
    sampled = sampled.orderBy(F.xxhash64(*names, "_cut")).limit(ranges * PER_RANGE)
    # One task sorts the sample, whose size is fixed.
    placed = sampled.withColumn("_at", F.row_number().over(Window.orderBy(*names, "_cut")))
    return placed.where(F.col("_at") % PER_RANGE == 0).groupBy(*names).agg(F.sort_array(F.collect_set("_cut")).alias("_cuts"))


def _rank(cuts: Column, at: Column, ranges: int) -> Column:
    """How many of the sorted ``cuts`` are at or before ``at``, by bisection."""
    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        passed = F.get(cuts, middle) <= at
        halved = F.struct(F.when(passed, middle + 1).otherwise(s["low"]).alias("low"), F.when(passed, s["high"]).otherwise(middle).alias("high"))
        return F.when(s["low"] < s["high"], halved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ranges.bit_length())), start, step)["low"]


def _blocks(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows with ``_block``, and those of cut keys alone. ``_block`` never decreases along ``order``."""
    ranges = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(df, keys, order, ranges)

    def placed(how: str) -> DataFrame:
        block = F.when(F.col("_cuts").isNotNull(), _rank(F.col("_cuts"), F.struct(*order), ranges)).otherwise(0)
        return _joined(df, cuts, keys, how).withColumn("_block", block).drop("_cuts")

    rows = placed("left")
    return rows.repartition(partitions, *keys, "_block") if partitions else rows, placed("inner")


def joined_wide(wide: DataFrame, narrow: DataFrame, key: str, order: list[str], partitions: int) -> DataFrame:
    """Inner join on ``key``, of which the rows of ``wide`` may have one alike: a cut key meets its ``narrow`` rows in every block."""
    rows, _ = _blocks(wide, [key], order, partitions)
    cuts = _cuts(wide, [key], order, partitions)
    last = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts"))
    other = _joined(narrow, cuts, [key], "left").withColumn("_block", F.explode(F.sequence(F.lit(0), last))).drop("_cuts")
    return rows.join(other, [key, "_block"]).drop("_block")


def _carried(totals: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """``columns`` of the totals, with the keys as _k0, ... and ``_block`` as ``_kn``."""
    return totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_block"])], *columns)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    descending: bool = False,
    strict_on: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add running ``values`` = {name: (sum|count|max|min, expression)}.

    Rows of a key follow one another by ``order``, nulls first. ``descending`` runs
    from the last row back. ``strict_on`` names an integral column: only rows
    strictly before the current one in that column count, so ties are left out.
    ``partitions`` says over how many the rows are dealt, as :func:`partitions_for` finds
    it for wide rows; else Spark decides.
    """

    def frame(window):
        if strict_on:
            window = window.orderBy(F.desc(strict_on) if descending else F.asc(strict_on))
            return window.rangeBetween(Window.unboundedPreceding, -1)
        window = window.orderBy(*[F.desc(c) if descending else F.asc(c) for c in order])
        return window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    rows, cut = _blocks(df, keys, [strict_on] if strict_on else order, partitions)
    totals = cut.groupBy(*keys, "_block").agg(
        *[_AGGREGATES[kind](value).alias(f"_total_{name}") for name, (kind, value) in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy(F.desc("_block") if descending else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(
        totals,
        keys,
        [
            _AGGREGATES["sum" if kind == "count" else kind](f"_total_{name}").over(before).alias(f"_before_{name}")
            for name, (kind, _) in values.items()
        ],
    )
    inside = frame(Window.partitionBy(*keys, "_block"))
    local = rows.select(
        "*", *[_AGGREGATES[kind](value).over(inside).alias(f"_here_{name}") for name, (kind, value) in values.items()]
    )
    return _joined(local, carried, [*keys, "_block"], "left").select(
        *[F.col(c) for c in df.columns],
        *[
            _merge(kind, F.col(f"_before_{name}"), F.col(f"_here_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Add ``previous`` and ``next``: ``value`` of the rows before and after in the key.

    ``value`` must not be null. Inside a block they are ``lag`` and ``lead``; at its
    ends the last value of the block before and the first of the one after.
    """
    rows, cut = _blocks(df, keys, order)
    ends = cut.withColumn("_value", value).groupBy(*keys, "_block").agg(
        F.min_by("_value", F.struct(*order)).alias("_first"), F.max_by("_value", F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = _carried(ends, keys, [F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after")])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = rows.select("*", F.lag(value).over(inside).alias("_lag"), F.lead(value).over(inside).alias("_lead"))
    return _joined(local, carried, [*keys, "_block"], "left").select(
        *[F.col(c) for c in df.columns],
        F.coalesce("_lag", "_before").alias("previous"),
        F.coalesce("_lead", "_after").alias("next"),
    )


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "position", partitions: int | None = None) -> DataFrame:
    """1-based position of each row within its key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, partitions=partitions)


def collected(df: DataFrame, keys: list[str], position: str, items: list[str], name: str, partitions: int) -> DataFrame:
    """Lists of ``items`` in the order of ``position``, for groups of bounded size."""
    listed = F.sort_array(F.collect_list(F.struct(position, *items))).alias("_sorted")
    lists = df.select(*keys, position, *items).repartition(partitions, *keys).groupBy(*keys).agg(listed)
    return lists.select(*keys, F.transform("_sorted", lambda s: F.struct(*[s[c].alias(c) for c in items])).alias(name))


def chunk_of(position: str, size: int) -> Column:
    return F.floor((F.col(position) - 1) / size).cast("long")


def chunked_lists(
    df: DataFrame, keys: list[str], order: list[str], items: list[str], size: int, name: str = "items", partitions: int | None = None
) -> DataFrame:
    """Ordered lists per key as rows (*keys, chunk, name), at most ``size`` items each.

    A key of usual size gives one row with chunk 0; a larger one gives more
    rows, so no group has to fit into one cell. Without ``partitions`` the input is
    read once more to find how many it fills.
    """
    partitions = partitions or partitions_for(df)
    numbered = ordinal(df, keys, order, "_position", partitions).withColumn("chunk", chunk_of("_position", size))
    return collected(numbered, [*keys, "chunk"], "_position", items, name, partitions)
