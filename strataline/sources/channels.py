"""Channel linkers: names of tables, topics, environment variables and GraphQL types in source texts."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from strataline.functions.text import line_numbers
from strataline.operators.relational import smallest_enclosing, top_within

# Fixed values: (kind, detail, pattern); the first that claims a name on a line holds
PATTERNS = [
    ("sql_table", "from", r"(?i)\bFROM\s+(?:[\"'`])?((?:\[[\w.]+\]|[\w.]+)(?:\.(?:\[[\w.]+\]|[\w.]+))?)"),
    ("sql_table", "join", r"(?i)\bJOIN\s+(?:[\"'`])?((?:\[[\w.]+\]|[\w.]+)(?:\.(?:\[[\w.]+\]|[\w.]+))?)"),
    ("sql_table", "into", r"(?i)\bINTO\s+(?:[\"'`])?((?:\[[\w.]+\]|[\w.]+)(?:\.(?:\[[\w.]+\]|[\w.]+))?)"),
    ("sql_table", "update", r"(?i)\bUPDATE\s+(?:[\"'`])?((?:\[[\w.]+\]|[\w.]+)(?:\.(?:\[[\w.]+\]|[\w.]+))?)"),
    ("queue_topic", "kafka:pub", r"producer\.send\s*\(\s*\{[^}]*?topic\s*:\s*['\"`]([\w.\-]+)['\"`]"),
    ("queue_topic", "kafka:sub", r"consumer\.subscribe\s*\(\s*\{[^}]*?topic\s*:\s*['\"`]([\w.\-]+)['\"`]"),
    ("queue_topic", "kafka:pub", r"Topic\s*:\s*['\"`]([\w.\-]+)['\"`]"),
    ("queue_topic", "kafka:pub", r"SetTopic\s*\(\s*['\"`]([\w.\-]+)['\"`]\s*\)"),
    ("queue_topic", "nats:pub", r"\.Publish\s*\(\s*['\"`]([\w.\-]+)['\"`]"),
    ("queue_topic", "nats:sub", r"\.Subscribe\s*\(\s*['\"`]([\w.\-]+)['\"`]"),
    ("queue_topic", "rabbitmq:pub", r"\.publish\s*\(\s*['\"`]([\w.\-]+)['\"`]"),
    ("queue_topic", "rabbitmq:sub", r"\.consume\s*\(\s*['\"`]([\w.\-]+)['\"`]"),
    ("queue_topic", "rabbitmq:sub", r"\.Consume\s*\(\s*['\"`]([\w.\-]+)['\"`]"),
    ("queue_topic", "redis:sub", r"\.subscribe\s*\(\s*['\"`]([\w.\-]+)['\"`]"),
    ("env_var", "node", r"process\.env\.([A-Z][A-Z0-9_]+)"),
    ("env_var", "node", r"process\.env\[\s*['\"`]([A-Z][A-Z0-9_]+)['\"`]\s*\]"),
    ("env_var", "vite", r"import\.meta\.env\.([A-Z][A-Z0-9_]+)"),
    ("env_var", "go", r"os\.Getenv\s*\(\s*['\"`]([A-Z][A-Z0-9_]+)['\"`]\s*\)"),
    ("env_var", "go", r"os\.LookupEnv\s*\(\s*['\"`]([A-Z][A-Z0-9_]+)['\"`]\s*\)"),
    ("env_var", "viper", r"viper\.Get\w*\s*\(\s*['\"`]([\w.]+)['\"`]\s*\)"),
    ("env_var", "python", r"os\.environ\[\s*['\"`]([A-Z][A-Z0-9_]+)['\"`]\s*\]"),
    ("env_var", "python", r"os\.environ\.get\s*\(\s*['\"`]([A-Z][A-Z0-9_]+)['\"`]"),
    ("env_var", "python", r"os\.getenv\s*\(\s*['\"`]([A-Z][A-Z0-9_]+)['\"`]"),
]
# Words that are no names, and words of SQL that may follow those before a table
STOPWORDS = frozenset({
    "a", "an", "and", "any", "all", "as", "at", "be", "but", "by", "can", "do", "each", "every", "for", "from", "has", "have", "here", "how", "if", "in", "is", "it", "its",
    "me", "more", "must", "no", "not", "now", "of", "on", "one", "only", "or", "our", "so", "some", "than", "that", "the", "then", "there", "these", "they", "this", "those",
    "to", "too", "two", "up", "us", "use", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your", "true", "false", "null",
})
SQL_RESERVED = frozenset({
    "select", "insert", "update", "delete", "where", "order", "group", "having", "limit", "offset", "as", "on", "using", "left", "right", "inner", "outer", "full", "cross",
    "natural", "into", "temporary", "temp", "recursive", "with", "union", "except", "intersect", "distinct", "all",
})
EXTRA = {"queue_topic": frozenset("event events message messages data msg topic topics".split()), "env_var": frozenset("path home user pwd shell lang tmp tmpdir temp".split())}
SQL_VERB = re.compile(r"\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|MERGE|REPLACE|UPSERT|WITH)\b", re.I)
_CTE = re.compile(r"\bWITH\s+(?:RECURSIVE\s+)?([\w,\s]+?)\s+AS\s*\(|\)\s*,\s*(\w+)\s+AS\s*\(", re.I)
_LITERAL = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|`(?:[^`\\]|\\.)*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_COMPILED = [(k, d, re.compile(p)) for k, d, p in PATTERNS]


def keep_identifier(value: str, kind: str = "", least: int = 3, sql_reserved: bool = False) -> bool:
    """Whether a captured word is a plausible name: long enough, with a letter, no stop word."""
    w = value.strip().lower()
    if len(w) < least or w in STOPWORDS or w in EXTRA.get(kind, ()) or (sql_reserved and w in SQL_RESERVED):
        return False
    return any("a" <= c <= "z" for c in w)


def table_name(raw: str) -> str:
    return raw.rsplit(".", 1)[-1].strip("[]")


def hits(text: str | None) -> list[tuple[str, str, int, str]]:
    """(kind, value, line, detail) of all channels in a source text, each name, kind and line once.

    A table counts only inside a string literal that also holds an SQL verb, and not if it is
    the name of a common table expression.
    """
    if not text:
        return []
    spans = [m.span() for m in _LITERAL.finditer(text)]
    starts = [a for a, _ in spans]
    line = line_numbers(text)
    ctes = {n.strip().lower() for m in _CTE.finditer(text) for n in (m[1] or m[2]).split(",")}
    out: dict[tuple[str, str, int], str] = {}
    for kind, detail, pattern in _COMPILED:
        for m in pattern.finditer(text):
            value = m[1]
            if kind == "sql_table":
                value = table_name(value)
                s, e = spans[i] if (i := bisect.bisect_left(starts, m.start()) - 1) >= 0 else (0, 0)
                if not s < m.start() < e or not SQL_VERB.search(text, s, e) or value.lower() in ctes:
                    continue
            if keep_identifier(value, kind, sql_reserved=kind == "sql_table"):
                out.setdefault((kind, value, line(m.start())), detail)
    return [(k, v, at, d) for (k, v, at), d in out.items()]


def link(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """(kind, value, line, detail, file_id, symbol_stable_id): hits credited to the smallest enclosing symbol.

    ``sources`` has (file_id, text) of files that are not tests; ``symbols`` (file_id, stable_id, line_start, line_end).
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *h) for f, t in zip(b["file_id"], b["text"]) for h in hits(t)]
            yield pd.DataFrame(rows, columns=["file_id", "kind", "value", "line", "detail"])

    found = sources.select("file_id", "text").mapInPandas(scan, "file_id long, kind string, value string, line int, detail string")
    credited = smallest_enclosing(found, symbols.select("file_id", "stable_id", "line_start", "line_end"), "file_id", "line", "line_start", "line_end", "stable_id", ["file_id", "kind", "value", "line", "detail"])
    return credited.withColumnRenamed("stable_id", "symbol_stable_id").dropDuplicates(["symbol_stable_id", "kind", "value", "line"])


def mirror_types(names: DataFrame, symbols: DataFrame, most: int = 25) -> DataFrame:
    """(name, stable_id): schema names joined to interfaces, types and classes of that name, the first ``most`` by file and line."""
    s = symbols.where(symbols.kind.isin("interface", "type", "class")).select("name", "stable_id", "file_id", "line_start")
    return top_within(names.select("name").distinct().join(s, "name"), ["name"], ["file_id", "line_start", "stable_id"], most).select("name", "stable_id")


_TEMPLATE = re.compile(r"\b(?:gql|graphql)\s*(?:\(\s*)?`((?:[^`\\]|\\.)*)`", re.S)


def graphql_templates(text: str | None) -> list[tuple[str, int]]:
    """(type name, line) of the schema types declared in template strings of a source text."""
    line = line_numbers(text or "")
    return [(name, line(m.start())) for m in _TEMPLATE.finditer(text or "") for name in graphql_types(m[1])]


def graphql_types(text: str | None) -> list[str]:
    """Type names declared in GraphQL text."""
    found = re.findall(r"^\s*(?:extend\s+)?(?:type|interface|input|enum|union|scalar)\s+(\w+)", text or "", re.M)
    return sorted({n for n in found if keep_identifier(n)})
