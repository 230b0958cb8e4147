"""Benchmark decontamination by templates.

Text is brought to a canonical template: names (a capital inside a sentence), numbers
and units after a number become typed placeholders, letters lower case, punctuation
goes. Windows of template words of the documents meet those of the benchmark items by
hash and are compared word by word. The windows of one occurrence (same document, item
and shift) also tell which value of the document stands for which value of the item:
only where this is one to one is the item the same question, with the same or with
other parameters. A document leaks an item when such occurrences hold at least
``share`` of the item's windows.

Everything is a DataFrame expression. The documents' windows first meet the hashes of
the benchmark's, which are broadcast while there are at most ``broadcast_windows`` of
them (8 bytes each) and joined by a shuffle beyond; what is left are hits. Hits are
counted by (document, item, shift) in aggregates combined before the shuffle, so
neither an item that stands in most documents nor a document of many items meets in one
task. Values are collected only within one occurrence, which is as long as its item.

Defined results: null and empty texts, and items without words, match nothing; an item of fewer
words than a window is one window; items with equal texts are reported each; rows that
repeat a ``doc_id`` are told apart by their text, and reported once each if it differs;
an empty table on either side gives an empty result; other columns are ignored, and
kept by ``drop_leaks`` whatever their names are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_key, stored

#: What counts as a unit behind a number.
UNITS = (
    "km|kilometers|kilometres|m|meters|metres|cm|centimeters|centimetres|mm|mi|miles|ft|feet|in|inches|yd|yards|"
    "kg|kilograms|g|grams|mg|t|tons|tonnes|lb|lbs|pounds|oz|ounces|l|liters|litres|ml|gal|gallons|"
    "s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|mph|kmh|"
    "dollars|cents|euros|usd|eur|percent|degrees|celsius|fahrenheit|watts|kwh|kb|mb|gb|tb"
)

#: Patterns and replacements in order; the marks n, d and u stand behind U+0001. They need no look-around.
STEPS = (
    (r"([\p{Ll}\p{Nd},;:] )(\p{Lu})", "{1}\u0001N{2}"),
    (r"(^|[^\p{L}\p{Nd}.,\x{01}])(\p{Nd})", "{1}\u0001D{2}"),
    (r"(\x{01}D[\p{Nd}.,]*) ?(" + UNITS + r")($|[^\p{L}\p{Nd}])", "{1} \u0001U{2}{3}"),
    (r"[^\p{L}\p{M}\p{Nd}\x{01}\x{09}-\x{0D}\x{20}]+", ""),
)
#: What is left of a marked word in the template.
SLOT = (r"\x{01}([ndu])[^\x{09}-\x{0D}\x{20}]*", "\u0001{1}")
_SPACE = r"[\x09-\x0D\x20]+"


def _replace(text: Column, pattern: str, by: str) -> Column:
    for i in (1, 2, 3):
        by = by.replace(f"{{{i}}}", f"${i}")
    return F.regexp_replace(text, pattern, by)


def marked(text: Column, common: list[str] | None = None, names: bool = True) -> Column:
    """Lower-case words, with names, numbers and units marked.

    With ``common`` every capitalised word but these is a name, wherever it stands; without
    ``names`` none is.
    """
    steps = STEPS if names and common is None else STEPS[1:]
    if names and common is not None:
        plain = lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{M}\p{Nd}]+", "")).isin(common)
        named = lambda x: F.when(F.rlike(x, F.lit(r"^[^\p{L}\p{Nd}]*\p{Lu}")) & ~plain(x), F.concat(F.lit("\u0001N"), x)).otherwise(x)
        text = F.array_join(F.transform(F.split(text, _SPACE), named), " ")
    for pattern, by in steps:
        text = _replace(text, pattern, by)
    return F.trim(F.regexp_replace(F.lower(text), _SPACE, " "))


def words_of(text: Column) -> Column:
    return F.when(text != "", F.split(text, " ")).otherwise(F.array().cast("array<string>"))


def common_words(items: DataFrame, share: float = 0.01) -> list[str]:
    """Words in lower case of at least two items and of ``share`` of the items: a share bounds their number by the items' length."""
    words = items.where("text IS NOT NULL").select(F.explode(F.array_distinct(F.transform(F.split("text", _SPACE), lambda x: F.regexp_replace(x, r"[^\p{L}\p{M}\p{Nd}]+", "")))).alias("word"))
    words = words.where(F.rlike("word", F.lit(r"^\p{Ll}")) & (F.col("word") == F.lower("word")))
    least = max(2, math.ceil(share * items.count()))
    return [r.word for r in words.groupBy("word").count().where(F.col("count") >= least).collect()]


def item_windows(items: DataFrame, window: int = 8, **marks) -> DataFrame:
    """``item_id``, ``windows`` (of the item), ``j``, ``wide``, ``template`` and ``values`` of each window; ``hash``."""
    canon = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), marked(F.col("text"), **marks).alias("marked"))
    canon = canon.select("item_id", words_of(F.col("marked")).alias("v"), words_of(_replace(F.col("marked"), *SLOT)).alias("w")).where(F.size("w") > 0).distinct()
    canon = canon.withColumn("wide", F.least(F.lit(window), F.size("w"))).withColumn("windows", F.size("w") - F.col("wide") + 1)
    every = canon.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    cut = lambda c: F.slice(c, F.col("j") + 1, F.col("wide"))
    return every.select("item_id", "windows", "j", "wide", cut("w").alias("template"), cut("v").alias("values")).withColumn("hash", F.xxhash64("template"))


def document_hits(docs: DataFrame, wanted: DataFrame, window: int, broadcast_windows: int, **marks) -> DataFrame:
    """Windows of the documents whose hash the benchmark has: ``key``, ``row``, ``i``, ``hash``, ``template``, ``values``."""
    hashes = wanted.select("wide", "hash").distinct()
    known = hashes.limit(broadcast_windows + 1).count() <= broadcast_windows
    hashes = F.broadcast(hashes) if known else hashes.hint("merge")
    # At most ``window`` widths; more than one only if the benchmark has items shorter than a window.
    widths = [r.wide for r in wanted.select("wide").distinct().collect()]
    canon = docs.where("text IS NOT NULL").select(id_key("doc_id").alias("key"), F.xxhash64("text").alias("row"), marked(F.col("text"), **marks).alias("marked"))
    canon = canon.withColumn("w", words_of(_replace(F.col("marked"), *SLOT)))
    canon = canon.withColumn("wide", F.explode(F.array(*[F.lit(n) for n in widths]))) if len(widths) > 1 else canon.withColumn("wide", F.lit(widths[0] if widths else window))
    # Any filter on the words, also the one that Spark derives from explode, would compute them a second time.
    places = F.when(F.size("w") >= F.col("wide"), F.sequence(F.lit(0), F.size("w") - F.col("wide")))
    every = canon.withColumn("i", F.explode_outer(places)).where("i IS NOT NULL")
    template = F.slice("w", F.col("i") + 1, F.col("wide"))
    every = every.withColumn("hash", F.xxhash64(template))
    hits = every.join(hashes, ["wide", "hash"], "left_semi")
    values = F.slice(F.split("marked", " "), F.col("i") + 1, F.col("wide"))
    return hits.select("key", "row", "i", "wide", "hash", template.alias("template"), values.alias("values"))


def matches(docs: DataFrame, items: DataFrame, window: int, broadcast_windows: int, **marks) -> DataFrame:
    """``key``, ``row``, ``item_id``, ``windows``, ``j``, ``shift`` and ``slots`` of every window of a document equal to one of an item."""
    wanted = item_windows(items, window, **marks)
    hits = document_hits(docs, wanted, window, broadcast_windows, **marks)
    same = wanted.select("item_id", "windows", "j", "wide", "hash", F.col("template").alias("item_template"), F.col("values").alias("item_values"))
    met = hits.join(same, ["wide", "hash"]).where(F.col("template") == F.col("item_template"))
    zipped = F.arrays_zip("template", "item_values", "values", F.sequence(F.col("j"), F.col("j") + F.col("wide") - 1).alias("at"))
    slots = F.filter(zipped, lambda s: F.startswith(s["template"], F.lit("\u0001")))
    return met.select("key", "row", "item_id", "windows", "j", (F.col("i") - F.col("j")).alias("shift"), slots.alias("slots"))


PLACE = ("key", "row", "item_id", "windows", "shift")


def enough(found: DataFrame, share: float) -> DataFrame:
    found = found.groupBy("key", "row", "item_id", "windows").agg(F.countDistinct("j").alias("matched"))
    return found.where(F.col("matched") >= F.col("windows") * F.lit(share)).select("key", "row", "item_id", "matched", F.col("windows").cast("long").alias("windows"))


def leaks(docs: DataFrame, items: DataFrame, window: int = 8, share: float = 0.5, broadcast_windows: int = 1_000_000) -> DataFrame:
    """``key``, ``row``, ``item_id``, ``matched`` and ``windows`` (of the item) of every leaked item of a document."""
    met = matches(docs, items, window, broadcast_windows)
    pairs = F.transform("slots", lambda s: F.struct(s["template"].alias("template"), s["item_values"].alias("item_values"), s["values"].alias("values")))
    found = met.groupBy(*PLACE).agg(F.collect_set("j").alias("js"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"))
    one_to_one = [F.size(F.array_distinct(F.col("slots")[n])) == F.size("slots") for n in ("item_values", "values")]
    found = found.where(one_to_one[0] & one_to_one[1])
    return enough(found.withColumn("j", F.explode("js")), share)


def partial_leaks(docs: DataFrame, items: DataFrame, window: int = 8, share: float = 0.5, broadcast_windows: int = 1_000_000) -> DataFrame:
    """Like ``leaks``, but a value that contradicts the others costs the windows that hold it, not the occurrence.

    Within an occurrence an item's value stands for the document's value that it meets at
    most places; different values may become one. A window counts if all its values are
    equal or all are those. Names are capitalised words that the items do not often have
    in lower case; texts are compared once with names as slots and once without.
    """
    words = common_words(items)
    both = []
    for marks in ({"common": words}, {"names": False}):
        met = stored(matches(docs, items, window, broadcast_windows, **marks), "matches")
        slot = met.select(*PLACE, "j", F.explode_outer("slots").alias("s")).select(*PLACE, "j", F.col("s.at").alias("at"), F.col("s.item_values").alias("old"), F.col("s.values").alias("new"))
        places = slot.where("at IS NOT NULL").select(*PLACE, "at", "old", "new").distinct().groupBy(*PLACE, "old", "new").agg(F.count("*").alias("n"))
        main = places.groupBy(*PLACE, "old").agg(F.max_by("new", F.struct("n", F.col("old") == F.col("new"), "new")).alias("main"))
        held = slot.join(main, [*PLACE, "old"], "left").groupBy(*PLACE, "j").agg(F.min(F.col("new") == F.col("main")).alias("mapped"), F.min(F.col("new") == F.col("old")).alias("equal"))
        both.append(enough(held.where(F.coalesce("mapped", F.lit(True)) | F.coalesce("equal", F.lit(True))), share))
    return both[0].unionByName(both[1]).groupBy("key", "row", "item_id").agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"))


def leak_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``item_id``, ``matched``, ``windows``: one row for each item that a document leaks."""
    found = leaks(docs.select("doc_id", "text"), items.select("item_id", "text"), **options)
    return found.select(F.when(F.col("key") != id_key(F.lit(None)), F.col("key")).alias("doc_id"), "item_id", "matched", "windows")


def drop_leaks(docs: DataFrame, items: DataFrame, partial: bool = False, **options) -> DataFrame:
    """``docs`` without those that leak an item (with ``partial`` by ``partial_leaks``). Same columns."""
    bad = (partial_leaks if partial else leaks)(docs.select("doc_id", "text"), items.select("item_id", "text"), **options).select("key", "row").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    same = (id_key(F.col("r.doc_id")) == bad["key"]) & (F.xxhash64("r.text") == bad["row"])
    return own.join(bad, same, "left_anti").select("r.*")


def _sql(text: str) -> str:
    for pattern, by in STEPS:
        for i in (1, 2, 3):
            by = by.replace(f"{{{i}}}", f"\\{i}")
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace(lower({text}), '{_SPACE}', ' ', 'g'))"


#: The same in DuckDB, for ids without repeats and nulls.
ORACLE = f"""
WITH t AS (SELECT 0 AS side, doc_id AS id, {_sql("text")} AS m FROM documents WHERE text IS NOT NULL
           UNION ALL SELECT 1, item_id, {_sql("text")} FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT side, id, string_split(m, ' ') AS v, string_split(regexp_replace(m, '{SLOT[0]}', '{SLOT[1].replace("{1}", chr(92) + "1")}', 'g'), ' ') AS w FROM t WHERE m <> ''),
widths AS (SELECT DISTINCT least(8, len(w)) AS wide FROM w WHERE side = 1),
x AS (SELECT side, id, wide, len(w) - wide + 1 AS windows, i, list_slice(w, i, i + wide - 1) AS w, list_slice(v, i, i + wide - 1) AS v
      FROM (SELECT side, id, w, v, wide, unnest(range(1, len(w) - wide + 2)) AS i FROM w, widths WHERE side = 0 OR wide = least(8, len(w)))),
m AS (SELECT d.id AS doc_id, b.id AS item_id, b.windows, b.i AS j, d.i - b.i AS shift, d.w, d.v AS dv, b.v AS bv
      FROM x d JOIN x b ON d.side = 0 AND b.side = 1 AND d.wide = b.wide AND d.w = b.w),
s AS (SELECT doc_id, item_id, shift, count(DISTINCT (w1, b1, d1)) AS n, count(DISTINCT b1) AS nb, count(DISTINCT d1) AS nd
      FROM (SELECT doc_id, item_id, shift, unnest(w) AS w1, unnest(bv) AS b1, unnest(dv) AS d1 FROM m) WHERE starts_with(w1, chr(1)) GROUP BY ALL),
g AS (SELECT m.doc_id, m.item_id, m.windows, count(DISTINCT m.j) AS matched FROM m LEFT JOIN s USING (doc_id, item_id, shift)
      WHERE s.n IS NULL OR (s.n = s.nb AND s.n = s.nd) GROUP BY ALL)
SELECT doc_id, item_id, matched, windows FROM g WHERE matched >= windows * 0.5
"""
