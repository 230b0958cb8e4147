"""Near copies by word shingles: texts whose sets of shingles have a Jaccard similarity of at least a bound.

This is an exact join. Two sets of similarity t or more have a share t of the larger one in
common, so under any order of all shingles they share one of the first n - ceil(t n) + 1
shingles of each, n being its size (prefix filter). The order puts frequent shingles last:
those that stand in more than ``LIST`` prefixes by hash order are marked in a bitmap of
fixed size. What many texts share by a licence or a common passage is then in no prefix,
unless a text consists of it; only what really makes a text similar is looked up.

Texts of the same words are one node, whatever their number. SimHash comes first: the
fingerprints of the five-word shingles meet by Golay-code keys (``simhash.links``), each node
is compared with the smallest one within two bits, and pairs that hold on the whole sets make
components. What SimHash finds needs no further comparison. The exact join then looks for
links between these components, where fingerprints are further apart; its nodes meet in the
lists of their prefix shingles, in two rounds:

1. A list of at most ``LIST`` nodes gives its pairs, as far as what is left of both from the
   shingle on can be enough (positional filter); in a longer one each node is compared
   with two leaders of about its size. Pairs are verified on the whole sets, and those that
   hold make components: a large group of near copies is one of them now.
2. Longer lists whose nodes are in different components give the pairs across these, but for
   those that parity sketches rule out: these bound from below by how much two sets differ.
   A pair with many lists in common is made in the first of them.

A pair in one component needs no comparison, so no link between components is missed, and
the pairs of a large group are never made.

At a similarity of 0.8 fingerprints by SimHash differ in about 15 % of their bits. A segment
of 23 bits then has two errors or fewer with a probability of 0.3 only, and the 12 bits of
one Golay codeword part too little; two codewords together would take some 1600 keys a text
at 256 bits, and still miss pairs. So SimHash links the closer copies, and the exact join
follows for the rest.

Defined results: words are parted by ASCII white space and compared in ASCII lower case; a
text of fewer words than a shingle is one shingle; null and empty texts and those of white
space are copies of each other; null and repeated ids are ids like any other, repeated rows
are copies; of equal rows (id and text) with different other columns the smallest stays;
very long texts have as many shingles as words, which one task holds for one text at a time;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, flat_bytes, id_key, released, small_batches, stored
from tidemark.llm.components import components
from tidemark.llm.simhash import _LOWER, first_rows, links

#: Nodes from which a list is long.
LIST = 16
#: Bits of the bitmap of frequent shingles, as a power of two; each shingle has two.
BITS = 23
#: 64-bit words of a parity sketch.
WORDS = 8
#: Lists of a node before a long one in which a pair is looked for before it is made again.
EARLIER = 8


def shingles(text: bytes, size: int) -> tuple[int, np.ndarray]:
    """A hash of a text's words and the distinct hashes of its shingles, sorted."""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    whole = digest(joined, 42)
    if not words:
        return whole, np.zeros(0, np.uint64)
    size = min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    view = memoryview(joined)
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return whole, np.unique(np.fromiter((digest(view[a:b], 42) for a, b in spans), np.uint64))


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set: by hash, those marked in ``frequent`` last."""
    low = np.uint64((1 << BITS) - 1)
    late = frequent[(hashes & low).astype(np.int64)] & frequent[(hashes >> np.uint64(BITS) & low).astype(np.int64)]
    ordered = np.concatenate([hashes[late == 0], hashes[late != 0]])
    return ordered[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def sketch(hashes: np.ndarray) -> list[int]:
    """The parity of the shingles that fall on each of 64 * ``WORDS`` places.

    Two sketches differ in at most as many places as the sets differ in shingles.
    """
    places = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(places.astype(np.uint8)).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is set if it is in over half of them."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(id_key("doc_id").alias("key"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))


def prints(docs: DataFrame, shingle: int, similarity: float, frequent: bytes) -> DataFrame:
    """``key``, ``row`` (hash of the text), ``node`` (hash of the words), ``n`` (distinct shingles), ``prefix``, ``sketch`` and ``fingerprint`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(frequent, np.uint8), bitorder="little") if frequent else np.zeros(1 << BITS, np.uint8)
        for batch in small_batches(batches, 2):
            flat, at = flat_bytes(batch.column(2))
            data = flat.tobytes()
            nodes, sizes, found, sketches, marked = [], [], [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                node, hashes = shingles(data[a:b], shingle)
                nodes.append(node)
                sizes.append(len(hashes))
                found.append(prefix(hashes, similarity, marks).view(np.int64))
                sketches.append(sketch(hashes))
                marked.append(fingerprint(hashes) if frequent else 0)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, pa.array(sketches, pa.list_(pa.int64())), pa.array(np.array(marked, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "row", "node", "n", "prefix", "sketch", "fingerprint"])

    return _rows(docs).mapInArrow(run, "key long, row long, node long, n int, prefix array<long>, sketch array<long>, fingerprint long")


def frequent_shingles(docs: DataFrame, shingle: int, similarity: float) -> bytes:
    """The bitmap of the shingles in more than ``LIST`` prefixes: 2^``BITS`` bits, put together from parts of 2^15."""
    tokens = prints(docs, shingle, similarity, b"").select(F.explode("prefix").alias("token"))
    many = tokens.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > LIST)
    places = [F.pmod(F.shiftright("token", shift), F.lit(1 << BITS)) + 1 for shift in (0, BITS)]
    bits = many.select(F.explode(F.array(*places)).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray(1 << BITS - 3)
    for r in parts.collect():  # at most 2^(BITS - 15) rows
        at = (r["part"] - 1) << 12
        out[at : at + 4096] = r["bits"]
    return bytes(out)


def lists(signed: DataFrame) -> DataFrame:
    """``token``, ``node``, ``n``, ``left`` (shingles of the node from this one on), ``size`` for the prefix shingles that several nodes have."""
    nodes = signed.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("at", "token")).select("node", "n", (F.col("n") - F.col("at")).alias("left"), "token")
    counts = entries.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    # Spark takes what was exploded for as small as what it came from, and would broadcast it.
    return entries.join(counts.hint("merge"), "token").select("token", "node", "n", "left", "size")


def _likely(similarity: float) -> Column:
    """Whether nodes of ``n`` and ``m`` shingles can be alike if they have none in common before this one.

    A similar pair meets at its first common shingle among others, where this holds.
    """
    overlap = (F.col("n") + F.col("m")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    return (F.least("n", "m") >= F.greatest("n", "m") * F.lit(similarity)) & (F.least("left", "other_left") >= overlap)


def print_pairs(signed: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of nodes by SimHash: each with the smallest of its fingerprint, and that with one at most two bits away."""
    firsts = stored(signed.groupBy("fingerprint").agg(F.min("node").alias("first")), "fingerprints")
    same = signed.select("node", "fingerprint").distinct().join(firsts.hint("merge"), "fingerprint").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(firsts)
    for end in ("a", "b"):
        near = near.join(firsts.select(F.col("fingerprint").alias(end), F.col("first").alias(f"{end}_node")).hint("merge"), end)
    apart = near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return same.where("a <> b").unionByName(apart).distinct()


def first_pairs(met: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (``a``, ``b``) of the short lists, and of each node of a long list with two leaders of about its size; none in one component.

    One has the smallest share of shingles before this one, so few of its own, and is nearer to the others than
    they are to each other. The other is drawn by a hash for each list, so a node that has many lists in common
    with a large group meets as many of its nodes.
    """
    met = met.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    short = met.where(F.col("size") <= LIST)
    other = short.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("left").alias("other_left"), F.col("root").alias("r"))
    apart = (F.col("node") < F.col("b")) & (F.col("root") != F.col("r"))
    pairs = short.join(other.hint("merge"), (short["token"] == other["token"]) & apart & _likely(similarity)).select(F.col("node").alias("a"), "b")
    about = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(similarity)))
    ranks = (1 - F.col("left") / F.col("n"), F.xxhash64("token", "node").cast("double"))
    leaders = [F.min(F.struct(r.alias("rank"), "node", "root")).over(Window.partitionBy("token", "_about")) for r in ranks]
    led = met.where(F.col("size") > LIST).withColumn("_about", about).select(F.array(*leaders).alias("l"), F.col("node").alias("b"), "root")
    led = led.select(F.explode("l").alias("l"), "b", "root")
    return pairs.unionByName(led.where("l.root <> root").select(F.col("l.node").alias("a"), "b")).distinct()


def possible(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs that the sizes and sketches don't rule out."""
    nodes = signed.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("s"))
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("s").alias(f"s_{end}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = sum((F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(WORDS)), F.lit(0))
    near = differ <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    sized = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(similarity) - F.lit(1e-6)
    return both.where(near & sized).select("a", "b")


def further_pairs(met: DataFrame, signed: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the long lists whose nodes are in different components, and whose sketches don't rule them out.

    A pair that has many lists in common is made in the first of them, and not in one behind it if any of the
    ``EARLIER`` lists before are those of both nodes. The first one has none before, so no pair is lost.
    """
    long = met.where(F.col("size") > LIST).join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = long.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    sketches = signed.groupBy("node").agg(F.first("sketch").alias("s")).select("node", *[F.col("s")[i].alias(f"s{i}") for i in range(WORDS)])
    long = long.join(split.hint("merge"), "token", "left_semi").select("token", "node", "n", "left", "root")
    before = Window.partitionBy("node").orderBy(F.desc("left")).rowsBetween(-EARLIER, -1)
    long = stored(long.withColumn("earlier", F.collect_list("token").over(before)).join(sketches.hint("merge"), "node"), "split-lists")
    other = long.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("left").alias("other_left"), F.col("root").alias("r"), F.col("earlier").alias("other_earlier"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(WORDS)])
    apart = (F.col("node") < F.col("b")) & (F.col("root") != F.col("r"))
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(WORDS)), F.lit(0))
    apart = apart & (differ <= (F.col("n") + F.col("m")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6))
    both = long.join(other.hint("merge"), (long["token"] == other["token"]) & apart & _likely(similarity) & ~F.arrays_overlap("earlier", "other_earlier"))
    return both.select(F.col("node").alias("a"), "b").distinct()


def sets(docs: DataFrame, signed: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node`` and its ``hashes`` for the ``wanted`` nodes, from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            flat, at = flat_bytes(batch.column(1))
            data = flat.tobytes()
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                hashes = shingles(data[a:b], shingle)[1].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([hashes], pa.list_(pa.int64()))], names=["node", "hashes"])

    one = signed.groupBy("node").agg(F.min(F.struct("key", "row")).alias("at")).join(wanted.hint("merge"), "node", "left_semi")
    one = one.select("node", "at.key", "at.row")
    texts = _rows(docs).join(one.hint("merge"), ["key", "row"]).select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(run, "node long, hashes array<long>")


def verified(docs: DataFrame, signed: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = stored(sets(docs, signed, wanted, shingle), "shingles")
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("hashes").alias("ha")).hint("merge"), "a")
    both = both.join(known.select(F.col("node").alias("b"), F.col("hashes").alias("hb")).hint("merge"), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    kept = stored(both.where(common >= (F.size("ha") + F.size("hb") - common) * F.lit(similarity)).select("a", "b"), "near-pairs")
    discard(known)
    return released(kept)


def near_groups(docs: DataFrame, signed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``node`` and ``root``, the smallest node of its group, for nodes in a group of several."""
    close = stored(possible(print_pairs(signed), signed, similarity), "pairs")
    found = verified(docs, signed, close, shingle, similarity)
    known = stored(components(found), "roots")
    met = released(stored(lists(signed), "lists"))
    pairs = stored(possible(first_pairs(met, known, similarity), signed, similarity), "pairs")
    near = found.unionByName(verified(docs, signed, pairs, shingle, similarity))
    roots = stored(components(near), "roots")
    discard(close)
    more = stored(further_pairs(met, signed, roots, similarity), "pairs")
    discard(pairs)
    if more.isEmpty():
        return roots
    return components(near.unionByName(verified(docs, signed, more, shingle, similarity)))


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: the first by ``doc_id`` (null ids first) and text hash. Same columns."""
    frequent = frequent_shingles(docs, shingle, similarity)
    signed = released(stored(prints(docs, shingle, similarity, frequent), "prefixes"))
    roots = near_groups(docs, signed, shingle, similarity)
    grouped = signed.select("key", "row", "node").join(roots.hint("merge"), "node", "left")
    return first_rows(docs, grouped.select("key", "row", F.coalesce("root", "node").alias("root")))
