"""Line dedup: delete runs of lines that repeat an earlier run.

A run counts if it has three lines (``run``), or if it is a single line of 60 bytes
(``line_bytes``): short lines such as headings and separators may stand in many texts
by themselves. For the latter the window is one line, which is its own fingerprint.

Winnowing over line hashes: in every window of ``run`` consecutive lines the
smallest line hash is a fingerprint, so any repeated run of that length shares one
at the same place. Fingerprints are counted; those that occur once are dropped.
Around the others the match is extended to both sides: every window that holds the
fingerprint is compared, as the sequence of its line hashes, with the first place
of that sequence. What a later window covers is deleted; windows that overlap add up
to the longest match.

No pairs are made: each window meets only the first place of its sequence, found by
an aggregate that is combined before the shuffle, and AQE splits the join for a
line that stands in most documents. Everything is a DataFrame expression.

Defined results: a line is what stands between line feeds, an empty text has one
empty line, a null text has none and stays null; a run is earlier if (doc_id, line)
is smaller, null ids first; rows with the same ``doc_id`` and text count as one
document, so neither removes the other, and rows with the same id and other text go
by their text's hash; an empty table gives an empty table; columns other than
``doc_id`` and ``text`` are kept by ``dedup_lines`` whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import folded, id_key, unfolded


def _lines() -> Column:
    return F.split("text", "\n")


def repeated_lines(docs: DataFrame, run: int = 3, line_bytes: int = 60) -> DataFrame:
    """``key``, ``row`` (hash of the text) and ``dead``: the line numbers to delete, for documents that have any.

    ``docs`` has ``doc_id`` and ``text``.
    """
    place = F.struct("key", "row", "start")
    keys = [id_key("doc_id").alias("key"), F.xxhash64("text").alias("row")]
    numbered = F.transform(_lines(), lambda x, i: F.struct(F.when(F.octet_length(x) >= line_bytes, F.xxhash64(x)).alias("h"), i.alias("start")))
    long = docs.select(*keys, F.inline(F.filter(numbered, lambda x: x["h"].isNotNull())))
    first_of = long.groupBy("h").agg(F.count("*").alias("places"), F.min(place).alias("earliest")).where("places > 1").select("h", "earliest")
    single = long.join(first_of, "h").where(place > F.col("earliest")).select("key", "row", F.col("start").alias("line"))

    hashed = docs.select(*keys, F.transform(_lines(), lambda x: F.xxhash64(x)).alias("h"))
    hashed = hashed.where(F.size("h") >= run).withColumn("n", F.size("h"))
    window = lambda i: F.slice(F.col("h"), i + 1, run)
    minima = F.transform(
        F.sequence(F.lit(0), F.col("n") - run),
        lambda i: F.struct(F.array_min(window(i)).alias("print"), (i + F.array_position(window(i), F.array_min(window(i))).cast("int") - 1).alias("at")),
    )
    prints = hashed.withColumn("f", F.explode(F.array_distinct(minima)))
    # The lines that any window with this fingerprint holds.
    first = F.greatest(F.lit(0), F.col("f.at") - (run - 1))
    around = F.slice("h", first + 1, F.lit(2 * run - 1))
    prints = prints.select("key", "row", F.col("f.print").alias("print"), F.col("f.at").alias("at"), first.alias("first"), around.alias("around"))
    common = prints.groupBy("print").agg(F.count("*").alias("places")).where("places > 1").select("print")
    starts = F.sequence(F.lit(0), F.least(F.col("at") - F.col("first"), F.size("around") - run))
    candidates = prints.join(common, "print").withColumn("i", F.explode(starts))
    candidates = candidates.select("key", "row", (F.col("first") + F.col("i")).alias("start"), F.slice("around", F.col("i") + 1, F.lit(run)).alias("lines"))
    earliest = candidates.groupBy("lines").agg(F.min(place).alias("earliest"))
    later = candidates.join(earliest, "lines").where(place > F.col("earliest"))
    lines = later.select("key", "row", F.explode(F.sequence(F.col("start"), F.col("start") + run - 1)).alias("line"))
    return lines.unionByName(single).groupBy("key", "row").agg(F.collect_set("line").alias("dead"))


def dedup_lines(docs: DataFrame, run: int = 3, line_bytes: int = 60) -> DataFrame:
    """``docs`` with later repeats of runs of ``run`` lines, or of one of ``line_bytes``, deleted from ``text``, and ``n_lines``, ``n_removed``."""
    dead = repeated_lines(docs.select("doc_id", "text"), run, line_bytes)
    rows = folded(docs, "doc_id", "text")
    same = (id_key(rows["doc_id"]) == dead["key"]) & (F.xxhash64(rows["text"]) == dead["row"])
    joined = rows.join(dead, same, "left").select(rows["doc_id"], rows["text"], "_rest", "dead").withColumn("_lines", _lines())
    count = F.coalesce(F.size("_lines"), F.lit(0))
    count = F.when(F.col("text").isNull(), 0).otherwise(count).cast("long")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("dead"))
    text = F.when(F.col("dead").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    removed = F.coalesce(F.size("dead"), F.lit(0))
    removed = F.when(F.col("dead").isNull(), 0).otherwise(removed).cast("long")
    out = joined.select("doc_id", text.alias("text"), "_rest", count.alias("_n"), removed.alias("_r"))
    return unfolded(out, docs.columns, ("doc_id", "text"), n_lines=F.col("_n"), n_removed=F.col("_r"))


#: The same in DuckDB, for ids without repeats and nulls.
ORACLE = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, list_slice(l, i, i + 2) AS run FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
x AS (SELECT doc_id, l[i] AS line, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
long AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM x WHERE strlen(line) >= 60) WHERE nth > 1),
dead AS (SELECT doc_id, i + k AS line FROM later, range(0, 3) t(k) UNION SELECT doc_id, i FROM long),
kept AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS text, count(*) AS n
         FROM x LEFT JOIN dead ON dead.doc_id = x.doc_id AND dead.line = x.i WHERE dead.line IS NULL GROUP BY x.doc_id)
SELECT o.doc_id, coalesce(len(d.l), 0) AS n_lines, coalesce(len(d.l) - coalesce(kept.n, 0), 0) AS n_removed,
       CASE WHEN o.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS kept_md5
FROM documents o LEFT JOIN d ON d.doc_id = o.doc_id LEFT JOIN kept ON kept.doc_id = o.doc_id
"""
