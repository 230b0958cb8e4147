"""Web pages as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MAX_PAGE_BYTES = 5 * 1024 * 1024
RAW_TEXT = ("script", "style", "noscript", "iframe")
SKIPPED = (*RAW_TEXT, "object", "embed")


def page_size_filter(pages: DataFrame, limit: int = MAX_PAGE_BYTES) -> DataFrame:
    """Pages fetched over http(s) and not above the size limit."""
    return pages.where(F.rlike("url", F.lit(r"\Ahttps?://")) & (F.octet_length("html") <= limit))


def html_text(html: Column) -> Column:
    """Text of a page without what scripts, styles and embedded objects hold.

    A skipped element hides the text up to the next other start tag, so text
    right behind a script is hidden too. Entities stay as written.
    """
    text = F.regexp_replace(html, r"(?s)<!--.*?(-->|\z)", "")
    for tag in RAW_TEXT:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)", "\x01")
    text = F.regexp_replace(text, r"(?i)<(object|embed)\b[^>]*>", "\x01")
    text = F.regexp_replace(text, r"<[A-Za-z][^>]*>", "\x02")
    text = F.regexp_replace(text, r"<[/!?][^>]*>", "")
    text = F.regexp_replace(text, r"\x01[^\x02]*", "")
    return F.btrim(F.regexp_replace(text, r"\x02", ""), F.lit(" \t\n\x0b\f\r"))


def pages_to_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", html_text(F.col("html"))).drop("html")
