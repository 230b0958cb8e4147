"""String functions: token estimates, wildcards, globs, masked secrets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units (a character outside the BMP counts twice)."""
    return F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1).cast("long")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded half up."""
    return F.floor((F.coalesce(utf16_length(text), F.lit(0)) + 2) / 4).cast("long")


def wildcard_regex(pattern: Column) -> Column:
    """Java regex for a ``*`` / ``?`` pattern; a final `` *`` is optional."""
    body = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    optional = F.concat(F.left(body, F.length(body) - 3), F.lit("( .*)?"))
    body = F.when(F.endswith(body, F.lit(" .*")), optional).otherwise(body)
    return F.concat(F.lit(r"(?s)\A"), body, F.lit(r"\z"))


def match_wildcard(text: Column, pattern: Column) -> Column:
    return F.rlike(text, wildcard_regex(pattern))


def wildcard_literal(pattern: str) -> str:
    """The same regex for a pattern known when the plan is built."""
    body = re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", pattern).replace("*", ".*").replace("?", ".")
    if body.endswith(" .*"):
        body = body[:-3] + "( .*)?"
    return rf"(?s)\A{body}\z"


def glob_regex(glob: str) -> str:
    """Java regex for a path glob. A glob without ``/`` matches at any depth."""
    out = r"\A" if "/" in glob else r"\A(?:.*/)?"
    depth = 0
    i = 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*"
            i += 2
            continue
        ch = glob[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "{":
            depth += 1
            out += "(?:"
        elif ch == "}" and depth:
            depth -= 1
            out += ")"
        elif ch == "," and depth:
            out += "|"
        elif ch == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return out + r"\z"


def mask_secret(secret: Column) -> Column:
    """First 7 and last 4 characters."""
    return F.concat(F.left(secret, F.lit(7)), F.lit("..."), F.right(secret, F.lit(4)))


def file_references(text: Column) -> Column:
    """``@path`` mentions that do not follow a word character or backtick."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\w`])@(\.?[^\s`,.]*(?:\.[^\s`,.]+)*)"), F.lit(1))


def shell_references(text: Column) -> Column:
    """Commands written as ``!`command` ``."""
    return F.regexp_extract_all(text, F.lit(r"!`([^`]+)`"), F.lit(1))


def default_title(title: Column) -> Column:
    """True for a title nobody has edited."""
    return F.rlike(
        title,
        F.lit(r"\A(New session - |Child session - )\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"),
    )
