"""Mix sources to target weights.

The words of each source, in order of its documents, are packed into blocks of a
fixed length. A source's target is met by a number of slots. Each slot goes to
one of the output shards by a multinomial draw, and names the block that stands
at its index in a pseudorandom permutation of the source's blocks. Joining slots
and blocks on (source, block) gives what the mix takes.

The draws are multinomial given the number of slots of each source, which is fixed
to the target beforehand: the totals come near the targets however small a source is.
Everything is a DataFrame expression, and all draws are hashes of ids, so a rerun
gives the same rows.

Defined results: a null text has no words; a null source is a source of its own and
ranks last; documents without words are returned with ``taken`` 0; rows that repeat
are packed and returned each; an empty table gives an empty table; columns other than
``doc_id``, ``text`` and ``source`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import folded, stored, unfolded, word_count

#: Rounds of the swap-or-not permutation.
ROUNDS = 12


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: ``source_size`` and ``target`` in words.

    Sources in code point order, null last, get ``weights`` in turn and divide
    ``share`` of all words; no target passes ``cap`` times its source, and what is
    above is divided again. ``sizes`` has ``source`` and ``size``. One row per source
    is ordered in one task; the rows of ``sizes`` are summed before.
    """
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A source takes its cap when the level reached by those before it lies above; the level is highest at the first that doesn't.
    ranked = ranked.withColumn(
        "level",
        (
            F.sum("source_size").over(everything) * F.lit(float(share))
            - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        )
        / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    )
    level = F.max("level").over(everything)
    return ranked.select("source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def pack(docs: DataFrame, targets: DataFrame, buckets: int = 256) -> DataFrame:
    """``docs`` (with ``size``) with ``offset``: the words of the source before this document.

    The running total is taken inside (source, bucket) and carried by one row per
    bucket, so that a source with most of the rows is spread over ``buckets`` tasks.
    (source, bucket, pos) identifies a row.
    """
    bucketed = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", F.xxhash64("text"))
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bucketed = bucketed.withColumn("pos", F.row_number().over(inside)).withColumn("local", before)
    sums = docs.select("source", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), "size")
    sums = sums.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    across = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "bucket", F.coalesce(F.sum("total").over(across), F.lit(0)).alias("base"))
    bases = bases.join(targets, bases["source"].eqNullSafe(targets["source"])).select(bases["source"], "bucket", "base", "source_size", "target")
    at = bucketed["source"].eqNullSafe(bases["source"]) & (bucketed["bucket"] == bases["bucket"])
    return bucketed.join(bases, at).select(*[bucketed[c] for c in bucketed.columns], "source_size", "target", (F.col("local") + F.col("base")).alias("offset"))


def permuted(index: Column, size: Column, key: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 .. ``size`` - 1.

    Swap-or-not: in each round x may swap with k - x mod size, as a hash of the larger
    of both tells; every round is a bijection on a range of any size.
    """

    def turn(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), size) - x, size)
        return F.when(F.xxhash64(key, i, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), turn)


def draw_slots(targets: DataFrame, block_words: int = 64, shard_slots: int = 8192, seed: int = 7) -> DataFrame:
    """One row per slot: ``source``, ``slot``, ``shard``, ``block``.

    A source of n blocks gets full passes over its blocks and part of one more, so no
    block is named more often than its target asks, rounded up.
    """
    blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round((F.col("target") - passes * F.col("source_size")) / block_words)
    plan = targets.where((F.col("source_size") > 0) & (F.col("target") > 0))
    plan = plan.select("source", blocks.alias("blocks"), (passes * blocks + F.least(rest, blocks)).cast("long").alias("slots"))
    plan = plan.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy()) / shard_slots)))
    pieces = plan.where("slots > 0").withColumn("piece", F.explode(F.expr(f"sequence(0L, (slots - 1) div {shard_slots})")))
    # Few small rows that grow a lot: dealt over all partitions, which AQE would join.
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(tasks, "source", "piece")
    slots = pieces.withColumn("slot", F.explode(F.expr(f"sequence(piece * {shard_slots}, least(slots, (piece + 1) * {shard_slots}) - 1)")))
    slots = slots.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), F.col("source"), F.col("slot")), F.col("shards")))
    pass_key = F.xxhash64(F.lit(seed), F.col("source"), F.floor(F.col("slot") / F.col("blocks")))
    slots = slots.withColumn("block", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), pass_key))
    return slots.select("source", "slot", "shard", "block")


def pieces_of(packed: DataFrame, block_words: int = 64) -> DataFrame:
    """The part of each document in each block: ``block``, ``first`` (word of the document, from 0), ``words``."""
    last = F.expr(f"(offset + size - 1) div {block_words}")
    spans = packed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"offset div {block_words}"), last)))
    first = F.greatest(F.col("block") * block_words, F.col("offset")) - F.col("offset")
    end = F.least((F.col("block") + 1) * block_words, F.col("offset") + F.col("size")) - F.col("offset")
    return spans.select("source", "bucket", "pos", "block", first.alias("first"), (end - first).alias("words"))


def take(packed: DataFrame, targets: DataFrame, block_words: int = 64, shard_slots: int = 8192, seed: int = 7) -> DataFrame:
    """The pieces that the mix takes, with ``times``: how often."""
    times = draw_slots(targets, block_words, shard_slots, seed).groupBy("source", "block").agg(F.count("*").alias("times"))
    # Spark takes what was exploded for as small as what it came from, and would broadcast it.
    times, pieces = times.hint("merge"), pieces_of(packed, block_words)
    same = pieces["source"].eqNullSafe(times["source"]) & (pieces["block"] == times["block"])
    return pieces.join(times, same).select(pieces["source"], "bucket", "pos", pieces["block"], "first", "words", "times")


def mix_sizes(docs: DataFrame, block_words: int = 64, seed: int = 7) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` words."""
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text"), word_count("text").alias("size"))
    sized = stored(sized, "mix-sizes")
    targets = source_targets(sized)
    packed = pack(sized, targets)
    taken = take(packed, targets, block_words, seed=seed)
    taken = taken.groupBy("source", "bucket", "pos").agg(F.sum(F.col("words") * F.col("times")).alias("taken")).hint("merge")
    same = packed["source"].eqNullSafe(taken["source"]) & (packed["bucket"] == taken["bucket"]) & (packed["pos"] == taken["pos"])
    joined = packed.join(taken, same, "left")
    return joined.select(packed["doc_id"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, block_words: int = 64, seed: int = 7) -> DataFrame:
    """The mix as documents: the columns of ``docs``, one row per document and copy.

    Copy c of a document holds the words taken at least c times, in their order; a
    copy with all words keeps its text as it is. ``n_chars``, where there is one,
    is the length of the new text.
    """
    columns = docs.columns
    rows = folded(docs, "doc_id", "text", "source").withColumn("size", word_count("text"))
    # Numbered once and written: the texts themselves are shuffled a single time, by their number.
    rows = stored(rows.withColumn("number", F.monotonically_increasing_id()), "mix-documents")
    names = ["number", "doc_id", "source", "text", "size"]
    narrow = rows.select("number", "doc_id", "source", F.xxhash64("text").alias("text"), "size").toDF(*names)
    targets = source_targets(narrow)
    packed = stored(pack(narrow, targets), "mix-packed")
    names = ["source", "bucket", "pos", "offset", "size"]
    taken = take(packed.select(*names).toDF(*names), targets, block_words, seed=seed)
    taken = taken.groupBy("source", "bucket", "pos").agg(F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("pieces")).hint("merge")
    same = packed["source"].eqNullSafe(taken["source"]) & (packed["bucket"] == taken["bucket"]) & (packed["pos"] == taken["pos"])
    found = packed.join(taken, same).select("number", "pieces").hint("merge")
    both = rows.join(found, "number").select("doc_id", "text", "source", "_rest", F.col("size").alias("_size"), "pieces")
    both = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.array_max(F.col("pieces.times")).cast("int"))))
    kept = F.filter("pieces", lambda p: p["times"] >= F.col("_copy"))
    both = both.withColumn("pieces", kept)
    count = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    words = F.regexp_extract_all("text", F.lit("(" + r"[^\x20\x09-\x0D]+" + ")"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(F.col("_words"), (p["first"] + 1).cast("int"), p["words"].cast("int")))), " ")
    both = both.withColumn("_words", F.when(count < F.col("_size"), words))
    both = both.withColumn("text", F.when(F.col("_words").isNull(), F.col("text")).otherwise(part))
    new = {"n_chars": F.length("text").cast("long")} if "n_chars" in columns else {}
    return unfolded(both, columns, ("doc_id", "text", "source"), **new)
