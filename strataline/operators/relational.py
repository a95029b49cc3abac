"""Small relational building blocks: enclosing ranges, longest prefixes, ranks, set differences, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_within(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits ranks before the shuffle."""
    return rank_within(df, keys, order, "__r").where(F.col("__r") <= n).drop("__r")


def smallest_enclosing(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, label: str, keep: list[str]) -> DataFrame:
    """The narrowest range with ``start <= at <= end`` of each point, by an equi-join on ``key``.

    Ties go to the smaller label; points outside every range have no row.
    """
    hit = points.join(ranges, key).where(F.col(at).between(F.col(start), F.col(end)))
    return hit.groupBy(*keep).agg(F.min_by(label, F.struct(F.col(end) - F.col(start), F.col(label))).alias(label))


def longest_prefix(paths: DataFrame, path: str, prefixes: DataFrame, prefix: str, label: str) -> DataFrame:
    """``paths`` with the label of the longest directory prefix that contains each, or null.

    Every path is exploded into its ancestor directories, which are equi-joined: no range
    join, and as many rows as paths have levels. The empty prefix contains everything.
    """
    parts = F.split(F.col(path), "/")
    depth = F.size(parts)
    ups = F.transform(F.sequence(F.lit(0), depth - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))
    exploded = paths.select(path).distinct().select(path, F.explode(ups).alias("u")).select(path, "u.depth", "u.dir")
    p = prefixes.select(F.regexp_replace(prefix, "/+$", "").alias("dir"), F.col(label)).groupBy("dir").agg(F.min(label).alias(label))
    best = exploded.join(p, "dir").groupBy(path).agg(F.max_by(label, "depth").alias(label))
    return paths.drop(label).join(best, path, "left") if label in paths.columns else paths.join(best, path, "left")


def glob_to_regex(pattern: str) -> str:
    """The five glob shapes: exact, ``**/dir/**``, ``**/*part*``, ``**/suffix``, ``*.ext``; others match nothing."""
    import re

    if "*" not in pattern:
        return "^" + re.escape(pattern) + "$"
    m = re.fullmatch(r"\*\*/([^*]+)/\*\*", pattern)
    if m:
        return "(^|/)" + re.escape(m[1]) + "/"
    m = re.fullmatch(r"\*\*/\*([^*/]+)\*", pattern)
    if m:
        return re.escape(m[1]) + "[^/]*$"
    m = re.fullmatch(r"\*\*/(\*?)([^*]+)", pattern)
    if m:
        return ("" if m[1] else "(^|/)") + re.escape(m[2]) + "$"
    m = re.fullmatch(r"\*(\.[^*/]+)", pattern)
    if m:
        return re.escape(m[1]) + "$"
    return "(?!)"


def matches_glob(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_to_regex(p))
    return out


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, modified or deleted rows between two states of a table."""
    a, b = old.select(key, F.col(content).alias("old")), new.select(key, F.col(content).alias("new"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return j.select(key, change.alias("change")).where(F.col("change").isNotNull())


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` replaced by those of ``new`` on the same keys (null-safe), and the rest of ``new``."""
    k = new.select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct()
    cond = None
    for c in keys:
        x = F.col(c).eqNullSafe(F.col(f"__{c}"))
        cond = x if cond is None else cond & x
    return old.join(k, cond, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose keys it lacks; of repeated new keys one row is taken."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh)
