"""Source files of a directory tree as a table, and what changed since the last time."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import text as fx
from strataline.operators.relational import diff, glob_to_regex

# Directories never entered, languages by extension, paths of tests
SKIP_DIRS = ("node_modules", ".git", "dist", "build", ".next", ".nuxt", ".output", "coverage", "__pycache__")
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "py": "python", "rs": "rust", "graphql": "graphql"}
TEST_PATH = r"(^|/)(tests?|__tests__)/|\.(test|spec)\.\w+$|_test\.(go|py)$|(^|/)test_[^/]*\.py$"


def ignore_rules(text: str) -> tuple[list[str], list[str]]:
    """(directories to skip, glob patterns) of a root ignore file; negations and comments are passed over."""
    dirs, globs = [], []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in "#!":
            continue
        body = line.lstrip("/")
        name, only_dir = body.rstrip("/"), body.endswith("/")
        if "/" not in name and "*" not in name and "?" not in name:
            dirs.append(name)
            globs.append(f"**/{name}/**" if only_dir else f"**/{name}")
        elif only_dir or "/" not in name:
            globs.append(f"**/{name}/**" if only_dir else f"**/{name}")
        else:
            globs.append(name)
    return dirs, globs


def discover(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, size_bytes, is_test, content_hash, content) of the source files under ``root``.

    Read by executors with the binary file source; languages, exclusions and the root ignore
    file are filters on the path. Files of unknown languages are left out.
    """
    base = root.removeprefix("file:").rstrip("/")
    dirs, globs = list(SKIP_DIRS), list(exclude)
    rules = os.path.join(base, ".gitignore")
    if os.path.isfile(rules):
        with open(rules, encoding="utf-8", errors="replace") as f:
            more, also = ignore_rules(f.read())
        dirs += more
        globs += also
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*(?=/)", "")
    rel = F.expr(f"substring(rel, {len(os.path.realpath(base)) + 2})")
    x = raw.withColumn("rel", path).withColumn("path", rel)
    skip = "(^|/)(" + "|".join(re.escape(d) for d in dirs) + ")(/|$)"
    keep = ~F.col("path").rlike(skip)
    for g in globs:
        keep = keep & ~F.col("path").rlike(glob_to_regex(g))
    language = F.element_at(F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv]), fx.extension(F.col("path")))
    return x.where(keep).select(
        "path", language.alias("language"), F.col("length").alias("size_bytes"), F.col("path").rlike(TEST_PATH).alias("is_test"),
        F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("content"),
    ).where(F.col("language").isNotNull())


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old_path): added, modified, deleted and renamed files by content hash.

    A deleted and an added path with one hash are a rename if the hash is unique on both sides.
    """
    d = diff(old.select("path", "content_hash"), new.select("path", "content_hash"), "path", "content_hash")
    gone = d.where(F.col("change") == "deleted").join(old.select("path", "content_hash"), "path").select(F.col("path").alias("old_path"), "content_hash")
    came = d.where(F.col("change") == "added").join(new.select("path", "content_hash"), "path").select("path", "content_hash")
    lone = lambda x: x.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select("content_hash")
    moved = gone.join(lone(gone), "content_hash", "left_semi").join(came.join(lone(came), "content_hash", "left_semi"), "content_hash").select("path", F.lit("renamed").alias("change"), "old_path")
    rest = d.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return rest.withColumn("old_path", F.lit(None).cast("string")).unionByName(moved)
