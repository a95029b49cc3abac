"""Git history: log text to commits and file changes, author maps, incremental reading."""

from __future__ import annotations

import re
import subprocess
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.session import Stored, shared_dir

MARK = "\x02commit\x02"
FORMAT = MARK + "%H%x09%an%x09%ae%x09%at%x09%s"
COMMITS = "hash string, author_name string, author_email string, authored_at long, subject string"
CHANGES = "commit_hash string, file_path string, status string, rename_from string"


def log_command(root: str, since: str | None = None) -> list[str]:
    """``git log`` of a repository, of commits after ``since`` if it is an ancestor of HEAD."""
    git = ["git", "-C", root]
    span = []
    if since and subprocess.run([*git, "merge-base", "--is-ancestor", since, "HEAD"], capture_output=True).returncode == 0:
        span = [f"{since}..HEAD"]
    return [*git, "log", "-M", "-C", "-z", "--name-status", f"--pretty=format:{FORMAT}", *span]


def stream_log(spark: SparkSession, root: str, since: str | None = None) -> str:
    """Path of a file in the shared folder with the log's text, written as git gives it, piece by piece."""
    jvm = spark.sparkContext._jvm
    path = f"{shared_dir(spark)}/strataline/log-{uuid.uuid4().hex}"
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    with subprocess.Popen(log_command(root, since), stdout=subprocess.PIPE) as git:
        while chunk := git.stdout.read(1 << 20):
            out.write(bytearray(chunk))
    out.close()
    if git.returncode:
        raise subprocess.CalledProcessError(git.returncode, "git log")
    return path


def parse_changes(body: str) -> list[tuple[str, str, str | None]]:
    """(path, status, rename_from) of a NUL-separated name-status list; copies count as added, other states are skipped."""
    out: list[tuple[str, str, str | None]] = []
    body = body.strip("\0\n")
    parts = [x.lstrip("\n") for x in body.split("\0")] if "\0" in body else re.split(r"[\t\n]", body)  # a tab may be part of a path
    fields = iter([x for x in parts if x])
    for state in fields:
        if state[0] in "RC" and state[1:].isdigit() or state in ("R", "C"):
            old, new = next(fields, None), next(fields, None)
            if old and new:
                out.append((new, "R" if state[0] == "R" else "A", old))
        else:
            path = next(fields, None)
            if path and state in ("A", "M", "D"):
                out.append((path, state, None))
    return out


def parse_log(raw: str, mark: str = MARK) -> tuple[list[tuple], list[tuple]]:
    """(commits, changes) of a log; pieces whose hash is not 40 hex digits are not commits. Times become milliseconds."""
    commits, changes = [], []
    for piece in raw.split(mark):
        head, _, body = piece.strip("\0").partition("\n")
        cells = head.rstrip("\0").split("\t")
        if len(cells) < 5 or not re.fullmatch(r"[0-9a-f]{40}", cells[0]) or not re.fullmatch(r"-?\d+", cells[3]):
            continue
        commits.append((cells[0], cells[1], cells[2], int(cells[3]) * 1000, "\t".join(cells[4:])))
        changes += [(cells[0], p, s, r) for p, s, r in parse_changes(body)]
    return commits, changes


def ingest(spark: SparkSession, root: str, since: str | None = None, relevant: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, file_changes) of a repository; ``relevant`` (path) keeps changes of those paths, also as rename sources.

    The log is streamed into the shared folder and parsed by the executors, one commit a row.
    """
    pieces = spark.read.option("lineSep", MARK).text(stream_log(spark, root, since))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b["value"]:
                commits, changes = parse_log(raw or "")
                rows += [(*c, [{"file_path": p, "status": s, "rename_from": r} for _, p, s, r in changes]) for c in commits]
            yield pd.DataFrame(rows, columns=["hash", "author_name", "author_email", "authored_at", "subject", "changes"])

    parsed = Stored(pieces.mapInPandas(parse, COMMITS + ", changes array<struct<file_path:string,status:string,rename_from:string>>"), "log").read()
    c = parsed.drop("changes")
    f = parsed.select(F.col("hash").alias("commit_hash"), F.explode("changes").alias("x")).select("commit_hash", "x.file_path", "x.status", "x.rename_from")
    if relevant is not None:
        p = relevant.select(F.col("path").alias("file_path")).distinct()
        old = f.join(p, "file_path", "left_anti").join(p.withColumnRenamed("file_path", "rename_from"), "rename_from", "left_semi")
        f = f.join(p, "file_path", "left_semi").unionByName(old)
    return c, f


def diff(spark: SparkSession, root: str, since: str) -> DataFrame:
    """(path, change, old_path): what differs between a commit and the work tree, untracked files included, as ``discovery.changes``."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout
    names = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed"}
    rows = [(p, names[s], old if s == "R" else None) for p, s, old in parse_changes(run("diff", "--name-status", "-M", "-z", since))]
    rows += [(p, "added", None) for p in run("ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]
    return spark.createDataFrame(rows, "path string, change string, old_path string")


def parse_mailmap(text: str) -> list[tuple[str | None, str, str, str]]:
    """(commit name or null, commit address, name, address) of the four line forms; later lines win."""
    rows = {}
    for line in text.splitlines():
        m = re.fullmatch(r"\s*([^<#]*?)\s*<([^>]+)>(?:\s*([^<]*?)\s*<([^>]+)>)?\s*(?:#.*)?", line)
        if not m or line.lstrip().startswith("#"):
            continue
        name, first, other, second = m[1], m[2].lower(), m[3], m[4]
        wrong = (second or m[2]).lower()
        entry = (name or first, first)
        rows[None, wrong] = entry
        if second and other:
            rows[other.lower(), wrong] = entry
    return [(k[0], k[1], *v) for k, v in rows.items()]


def apply_mailmap(commits: DataFrame, mailmap: DataFrame) -> DataFrame:
    """Commits with authors replaced: by (name, address), else by address; never by name alone.

    ``mailmap`` has (from_name, from_email, to_name, to_email), as many rows as the map has lines.
    """
    pair = mailmap.where(F.col("from_name").isNotNull()).select(F.col("from_name").alias("__n"), F.col("from_email").alias("__e"), F.col("to_name").alias("__n1"), F.col("to_email").alias("__e1"))
    mail = mailmap.where(F.col("from_name").isNull()).select(F.col("from_email").alias("__m"), F.col("to_name").alias("__n2"), F.col("to_email").alias("__e2"))
    x = commits.join(pair, (F.lower("author_name") == F.col("__n")) & (F.lower("author_email") == F.col("__e")), "left").join(mail, F.lower("author_email") == F.col("__m"), "left")
    return x.select(
        *[c for c in commits.columns if c not in ("author_name", "author_email")],
        F.coalesce("__n1", "__n2", "author_name").alias("author_name"), F.coalesce("__e1", "__e2", "author_email").alias("author_email"),
    ).select(*commits.columns)


def after_watermark(rows: DataFrame, col: str, watermark: int | None) -> DataFrame:
    return rows if watermark is None else rows.where(F.col(col) > watermark)
