"""Spelling variants by PartEnum signatures of letter multisets.

A word's letters are a binary vector with one dimension for the k-th occurrence of a
letter. One inserted or deleted letter changes one dimension, a replaced one two: words
one edit apart have a Hamming distance of at most two. The dimensions are hashed into
``PARTS`` parts. Two differing dimensions touch at most two parts, so the words agree on
all others: a signature is the content of one choice of ``PARTS`` - 2 parts, and every
choice is enumerated. Vectors of at most that distance share a signature, always.

An edit also leaves the first or the second half of the longer word as it is. That half
and the longer word's length are part of the signature, which keeps the lists behind it
short; they hold different words only, whatever the corpus repeats. Words with equal
signatures are joined and verified by their edit distance. Counts are combined before
their shuffle, so that a word with a third of all occurrences is no burden.

A word's form is its most frequent near word, if that is at least twice as frequent.
Counts grow along forms, so following them ends; pointers are doubled, round by round.

Defined results: a null or empty text has no words; a null ``doc_id`` counts as an empty
one in the noise rule; rows that repeat count each; texts of any length are cut into
runs inside their row; ties go to the smaller word in code-point order; an empty table
gives an empty table; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored

#: A run of letters.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Parts of the dimensions; signatures keep all but two.
PARTS = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, noise: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``word`` and ``n``, its occurrences.

    Every ``noise``-th run, by the checksum of ``<doc_id>:<run>``, loses the letter at
    the checksum's remainder by its length. ``noise`` 0 leaves all runs as they are.
    """
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    runs = docs.select(id_text, F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # A shorter run never becomes a word; lower() may only see ASCII, as it knows more capitals than A-Z.
    runs = runs.where(F.length("run") >= min_length)
    plain = F.length("run") == F.octet_length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    word = F.col("run")
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % noise == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def signatures(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``longer`` (whether the signature is of words no longer than this one) and ``key``, 24 rows a word."""
    letters = F.array_sort(F.filter(F.split("word", ""), lambda c: c != ""))
    rows = words.withColumn("letters", letters)
    kth = F.transform("letters", lambda c, i: F.xxhash64(c, i - F.array_position(F.col("letters"), c)))
    rows = rows.withColumn("dims", kth)
    zero = F.lit(0).cast("long")

    def content(part: int) -> Column:
        mine = F.filter("dims", lambda d: F.pmod(F.shiftright(d, 32), F.lit(PARTS)) == part)
        return F.aggregate(mine, zero, lambda s, d: s.bitwiseXOR(d))

    rows = rows.select("word", "n", F.array(*[content(p) for p in range(PARTS)]).alias("parts"))
    # ``more``: the length of the longer word, as far as this one knows, less its own.
    kinds = [F.struct(F.lit(more).alias("more"), F.lit(side).alias("side"), *[F.lit(p).alias(f"p{i}") for i, p in enumerate(choice)])
             for more in (0, 1) for side in (0, 1) for choice in combinations(range(PARTS), PARTS - 2)]
    rows = rows.select("word", "n", "parts", F.inline(F.array(*kinds)))
    length = F.length("word") + F.col("more")
    half = F.floor(length / 2).cast("int")
    last = F.substring("word", F.length("word") - (length - half) + 1, length - half)
    text = F.when(F.col("side") == 0, F.substring("word", F.lit(1), half)).otherwise(last)
    chosen = [F.col(f"p{i}") for i in range(PARTS - 2)]
    kept = reduce(lambda a, b: a.bitwiseXOR(b), [F.col("parts")[c] for c in chosen])
    return rows.select("word", "n", (F.col("more") == 0).alias("longer"), F.xxhash64(length, "side", *chosen, text, kept).alias("key"))


def near_words(words: DataFrame) -> DataFrame:
    """Every two words of ``words`` one edit apart, both ways: ``word``, ``n``, ``near``, ``near_n``."""
    keyed = signatures(words)
    left = keyed.where("longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    shorter = (F.length("b") < F.length("a")) | ((F.length("b") == F.length("a")) & (F.col("b") < F.col("a")))
    # Spark takes what was multiplied for as small as what it came from, and would broadcast it.
    pairs = left.join(right.hint("merge"), "key").where(shorter).where(F.levenshtein("a", "b", 1) == 1)
    pairs = pairs.select("a", "a_n", "b", "b_n").distinct()
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for the acyclic pointers ``word`` -> ``form``: each round doubles the steps taken."""
    ends = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stored(longer, "spelling-roots")
        discard(ends)
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        ends = moved


def variants(docs: DataFrame, noise: int = 97, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """Per word of ``docs``: ``word``, ``n``, ``n_near`` (near words), ``form``, ``form_n`` and ``root``."""
    words = stored(word_counts(docs, noise, min_length, min_count), "spelling-words")
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = -F.col("best.less") >= ratio * F.col("n")
    best = best.select("word", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"))
    best = stored(best, "spelling-forms")
    last = roots(best.where("form is not null"))
    full = words.join(best, "word", "left").join(last, "word", "left")
    return full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
