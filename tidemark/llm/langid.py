"""Language identification by compression.

A language is a raw-content zstandard dictionary of sample text. A text is put in
lower case, runs of other characters than letters become one space, it is cut into
pieces, each piece is compressed with every dictionary, and the language whose
compressed sizes add up to least wins; the relative distance to the second is the
score, and narrow ones can be rejected.

Only the sample that the dictionaries are made of is bounded: about ``per_lang``
rows of each language, picked by a hash of their id, of each ``row_bytes`` at most
(taken from a place that the hash tells). Prediction reads every byte of every text.

Defined results: a text that is null or has no letter is ``und`` with score 0; with
ties the smaller name wins, score 0; with one language every text gets it with score
1; with none (an empty or unlabelled table) every text is ``und``; rows that repeat
get the same prediction; other columns are ignored, and kept by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import flat_bytes, small_batches

UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def letters_only(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " ")


def learn(docs: DataFrame, per_lang: int = 64, row_bytes: int = 500) -> dict[str, bytes]:
    """One dictionary per language of ``docs`` (``doc_id``, ``text``, ``lang``), of ``per_lang`` * ``row_bytes`` bytes at most.

    Reaches the driver with about ``per_lang`` rows a language, however large the table is.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Id and text together: rows without an id, or with one that repeats, are drawn like any other.
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(2**40)) / float(2**40)
    start = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1), F.length("text") - row_bytes)).cast("int") + 1
    piece = F.substring("text", start, F.lit(row_bytes))
    labelled = labelled.select("lang", piece.alias("text"), chance.alias("chance"))
    # The row with the smallest chance is always taken, so that every language has one.
    seen = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.min_by("text", "chance").alias("text")).collect()
    if not seen:
        return {}
    rows = F.create_map(*[F.lit(v) for r in seen for v in (r.lang, r.rows)])[F.col("lang")]
    picked = labelled.where(F.col("chance") * rows < per_lang).select("lang", "text").distinct()
    samples: dict[str, list[bytes]] = {}
    for lang, text in sorted({*[(r.lang, r.text) for r in picked.collect()], *[(r.lang, r.text) for r in seen]}):
        samples.setdefault(lang, []).append(letters_only(pa.array([text]))[0].as_py().encode()[:row_bytes])
    return {lang: b"\n".join(texts) for lang, texts in sorted(samples.items())}


def _compressors(model: dict[str, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for sample in model.values():
        words = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def predict(docs: DataFrame, model: dict[str, bytes], level: int = 5, piece_bytes: int = 4096) -> DataFrame:
    """``docs`` (a ``text`` column and any others) with ``lang_pred`` and ``score``."""
    langs = list(model)
    kept = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(model, level)
        for batch in small_batches(batches, "text"):
            texts = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            flat, at = flat_bytes(letters_only(texts))
            view = memoryview(flat)
            names, scores = [], np.zeros(len(texts))
            for i, known in enumerate(letters):
                if not known or not tools:
                    names.append(UNKNOWN)
                    continue
                sizes = np.zeros(len(tools))
                for start in range(int(at[i]), int(at[i + 1]), piece_bytes):
                    piece = view[start : min(start + piece_bytes, int(at[i + 1]))]
                    sizes += [len(tool.compress(piece)) for tool in tools]
                best = int(np.argmin(sizes))
                names.append(langs[best])
                scores[i] = 1.0 - sizes[best] / np.min(np.delete(sizes, best)) if len(tools) > 1 else 1.0
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select(*[f.name for f in kept], "text").mapInArrow(run, schema)


def identify(docs: DataFrame, model: dict[str, bytes], margin: float = 0.0) -> DataFrame:
    """``docs`` of an accepted language: not ``und``, and the score reaches ``margin``. Same columns."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = predict(packed, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= margin))
    return found.select("row.*")


def language_report(docs: DataFrame, **options) -> DataFrame:
    """Learn from the documents that are not held out, and predict all: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"), **options)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
