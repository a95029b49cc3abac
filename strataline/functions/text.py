"""Scalar functions as column expressions."""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(path: Column, kind: Column, qualified_name: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, kind, qualified_name), 256), 1, 32)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def module_id(manifest: Column) -> Column:
    return F.substring(F.sha2(manifest, 256), 1, 16)


def embed_hash(salt: str, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, 16)


def route(path: Column) -> Column:
    """Route for links within a repository: trimmed, lower case, no end slash, any parameter style as {param}."""
    x = F.regexp_replace(F.lower(F.trim(path)), r"/+$", "")
    x = F.regexp_replace(x, r"\$\{[^}]*\}", "{param}")
    x = F.regexp_replace(x, r"\{[^}]*\}", "{param}")
    return F.regexp_replace(x, r":[a-z_][a-z0-9_]*", "{param}")


def plain_route(path: Column) -> Column:
    """Route for links between projects: no end slash, lower case."""
    return F.lower(F.regexp_replace(path, r"/+$", ""))


def table_name(raw: Column) -> Column:
    """Table name without brackets and quotes, the last part of a dotted name."""
    return F.lower(F.substring_index(F.regexp_replace(raw, r"[\[\]\"`]", ""), ".", -1))


def sanitize(query: str) -> str:
    """Search text with ASCII letters, digits, underscores and blanks only."""
    return re.sub(r"[^a-zA-Z0-9_\s]", "", query)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    b = basename(path)
    return F.when(b.contains("."), F.lower(F.substring_index(b, ".", -1)))


def iso_day(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")


def since_days(days: int, now_millis: int) -> int:
    return now_millis - days * 86_400_000


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def embed_text(kind: Column, name: Column, path: Column, signature: Column, doc: Column, body: Column, limit: int = 3000) -> Column:
    """Text a symbol is embedded by, cut to ``limit`` characters, its comment to 200."""
    head = F.concat_ws(" ", F.concat(F.lit("search_document: "), kind), name, F.lit("in"), basename(path), signature, F.substring(doc, 1, 200), body)
    return F.substring(head, 1, limit)


def is_component_name(name: Column) -> Column:
    """First character is an upper-case letter that has a lower case."""
    first = F.substring(name, 1, 1)
    return (first == F.upper(first)) & (first != F.lower(first))


def line_numbers(text: str):
    """A function from an offset in ``text`` to its line, counted from 1."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect.bisect_left(breaks, at) + 1
