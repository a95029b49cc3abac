"""Questions about the commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.plans import starts
from strataline.tables import Tables, with_views


def _limit(n: int | None) -> int:
    return min(max(n if n is not None else 50, 1), 500)


def _not_test(t: Tables, rows: DataFrame, col: str) -> DataFrame:
    tests = t.files.where("is_test").select(F.col("path").alias(col))
    return rows.join(tests, col, "left_anti")


def churn(t: Tables, prefix: str | None = None, since: int | None = None, branch: DataFrame | None = None, include_tests: bool = False, limit: int | None = 50) -> DataFrame:
    """Commits, contributors, last touch and top author of each path, most changed first.

    ``branch`` is a table of commit hashes (column hash). The top author ignores the
    filters and ties go to the smaller address. ``limit`` is clamped to 1..500; None lists all.
    """
    x = t.changes.select("commit_hash", "file_path").join(t.commits.withColumnRenamed("hash", "commit_hash"), "commit_hash")
    by_author = x.groupBy("file_path", "author_email").agg(F.count(F.lit(1)).alias("n"), F.min("author_name").alias("name"))
    top = by_author.groupBy("file_path").agg(F.min_by("name", F.struct(-F.col("n"), F.col("author_email"))).alias("top_author"))
    if prefix:
        x = x.where(F.lower("file_path").startswith(prefix.lower()))
    if since is not None:
        x = x.where(F.col("authored_at") >= since)
    if branch is not None:
        x = x.join(branch.select(F.col("hash").alias("commit_hash")), "commit_hash", "left_semi")
    if not include_tests:
        x = _not_test(t, x, "file_path")
    agg = x.groupBy("file_path").agg(
        F.count_distinct("commit_hash").alias("commits"), F.count_distinct("author_email").alias("contributors"), F.max("authored_at").alias("last_touched_at")
    )
    out = agg.join(top, "file_path")
    return out if limit is None else out.orderBy(F.desc("commits"), F.desc("last_touched_at"), "file_path").limit(_limit(limit))


def file_history(t: Tables, path: str | None = None) -> DataFrame:
    """All commits that touched each path (or one path) with status and rename source."""
    c = t.changes if path is None else t.changes.where(F.col("file_path") == path)
    x = c.join(t.commits.withColumnRenamed("hash", "commit_hash"), "commit_hash")
    return x.select("file_path", "commit_hash", "author_name", "author_email", "authored_at", "subject", "status", "rename_from")


def contributors(t: Tables, per_file: bool = False) -> DataFrame:
    """Commits per author address; of an address's names the smallest is shown."""
    keys = ["author_email"]
    x = t.commits
    if per_file:
        keys = ["file_path", "author_email"]
        x = t.changes.join(t.commits.withColumnRenamed("hash", "commit_hash"), "commit_hash")
    return x.groupBy(*keys).agg(F.min("author_name").alias("author_name"), F.count(F.lit(1)).alias("commits"))


def last_changed(t: Tables) -> DataFrame:
    """The newest commit of each path; ties go to the larger hash."""
    x = t.changes.select("commit_hash", "file_path").distinct().join(t.commits.withColumnRenamed("hash", "commit_hash"), "commit_hash")
    row = F.struct("commit_hash", "author_name", "author_email", "authored_at", "subject")
    return x.groupBy("file_path").agg(F.max_by(row, F.struct("authored_at", "commit_hash", "author_name", "author_email", "subject")).alias("r")).select("file_path", "r.*")


def co_change(t: Tables, min_count: int = 2, include_tests: bool = False, limit: int | None = None, wide: int = 500) -> DataFrame:
    """(file_a, file_b, count, jaccard) of paths that changed in the same commits.

    Baskets are de-duplicated. A commit's paths are paired by an equi-join on its hash; a
    commit that touches more than ``wide`` paths is split by the hash of the path on one
    side and copied to the splits on the other, so no task pairs all of it up.
    """
    f = t.changes.select("commit_hash", "file_path").distinct()
    counts = f.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    splits = f.groupBy("commit_hash").agg(F.ceil(F.count(F.lit(1)) / wide).cast("int").alias("k"))
    sized = f.join(splits, "commit_hash")
    a = sized.select("commit_hash", F.col("file_path").alias("file_a"), F.pmod(F.xxhash64("file_path"), F.col("k")).cast("int").alias("s"))
    b = sized.select("commit_hash", F.col("file_path").alias("file_b"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"))
    pairs = a.join(b, ["commit_hash", "s"]).where(F.col("file_a") < F.col("file_b")).groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    if not include_tests:
        pairs = _not_test(t, _not_test(t, pairs, "file_a"), "file_b")
    ca, cb = counts.select(F.col("file_path").alias("file_a"), F.col("n").alias("na")), counts.select(F.col("file_path").alias("file_b"), F.col("n").alias("nb"))
    out = pairs.join(ca, "file_a").join(cb, "file_b").select("file_a", "file_b", "count", F.round(F.col("count") / (F.col("na") + F.col("nb") - F.col("count")), 6).alias("jaccard"))
    return out if limit is None else out.orderBy(F.desc("jaccard"), "file_a", "file_b").limit(_limit(limit))


def monthly_activity(t: Tables, months: int = 12) -> DataFrame:
    """(month, commits) of the last ``months`` months up to the newest commit, zero-filled (UTC)."""
    c = t.commits.select("hash", F.trunc(F.timestamp_millis("authored_at").cast("date"), "month").alias("m")).distinct()
    span = c.agg(F.max("m").alias("hi")).select(F.explode(F.sequence(F.add_months("hi", 1 - months), F.col("hi"), F.expr("interval 1 month"))).alias("m"))
    n = c.groupBy("m").agg(F.count_distinct("hash").alias("n"))
    return span.join(n, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("commits"))


def _q(f, **kw):
    return lambda spark, d: f(Tables(spark, d), **kw)


QUERIES = {
    "git_churn": _q(churn, limit=None),
    "git_churn_top": _q(churn),
    "git_churn_prefix_since": lambda s, d: churn(t := Tables(s, d), prefix=starts.largest_project(t) + "/", since=1_600_000_000_000, include_tests=True, limit=None),
    "git_file_history": _q(file_history),
    "git_contributors": _q(contributors),
    "git_contributors_per_file": _q(contributors, per_file=True),
    "git_last_changed": _q(last_changed),
    "git_co_change": _q(co_change),
    "git_co_change_top": _q(co_change, limit=50),
    "git_monthly_activity": _q(monthly_activity),
}

_CHURN = """WITH x AS (SELECT DISTINCT h.commit_hash, h.file_path, c.author_email, c.author_name, c.authored_at, h.status, h.rename_from, c.subject
  FROM ch h JOIN cc c ON c.hash = h.commit_hash),
y AS (SELECT file_path, author_email, count(*) AS n, min(author_name) AS name FROM x GROUP BY ALL),
top AS (SELECT file_path, name AS top_author FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY n DESC, author_email) AS r FROM y) WHERE r = 1),
churn AS (SELECT x.file_path, count(DISTINCT commit_hash) AS commits, count(DISTINCT author_email) AS contributors, max(authored_at) AS last_touched_at
  FROM x WHERE {where} GROUP BY x.file_path)
SELECT churn.*, top_author FROM churn JOIN top USING (file_path)"""
_NOT_TEST = "NOT EXISTS (SELECT 1 FROM fc f WHERE f.path = {} AND f.is_test)"
_CO = """WITH f AS (SELECT DISTINCT commit_hash, file_path FROM ch), n AS (SELECT file_path, count(*) AS n FROM f GROUP BY 1),
p AS (SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS count FROM f a JOIN f b ON a.commit_hash = b.commit_hash AND a.file_path < b.file_path GROUP BY ALL HAVING count(*) >= 2)
SELECT file_a, file_b, count, round(count / (x.n + y.n - count), 6) AS jaccard FROM p JOIN n x ON x.file_path = file_a JOIN n y ON y.file_path = file_b
WHERE """ + _NOT_TEST.format("file_a") + " AND " + _NOT_TEST.format("file_b")  # fmt: skip

ORACLE = {
    "git_churn": with_views(_CHURN.format(where=_NOT_TEST.format("x.file_path"))),
    "git_churn_top": with_views(_CHURN.format(where=_NOT_TEST.format("x.file_path")) + " ORDER BY commits DESC, last_touched_at DESC, file_path LIMIT 50"),
    "git_churn_prefix_since": with_views(_CHURN.format(where="starts_with(lower(x.file_path), lower((SELECT project FROM bp)) || '/') AND authored_at >= 1600000000000")),
    "git_file_history": with_views(
        "SELECT h.file_path, h.commit_hash, c.author_name, c.author_email, c.authored_at, c.subject, h.status, h.rename_from FROM ch h JOIN cc c ON c.hash = h.commit_hash"
    ),
    "git_contributors": with_views("SELECT author_email, min(author_name) AS author_name, count(*) AS commits FROM cc GROUP BY 1"),
    "git_contributors_per_file": with_views(
        "SELECT h.file_path, c.author_email, min(c.author_name) AS author_name, count(*) AS commits FROM ch h JOIN cc c ON c.hash = h.commit_hash GROUP BY 1, 2"
    ),
    "git_last_changed": with_views(
        """SELECT file_path, commit_hash, author_name, author_email, authored_at, subject FROM (
        SELECT h.file_path, h.commit_hash, c.author_name, c.author_email, c.authored_at, c.subject,
          row_number() OVER (PARTITION BY h.file_path ORDER BY c.authored_at DESC, h.commit_hash DESC, c.author_name DESC, c.author_email DESC, c.subject DESC) AS r
        FROM (SELECT DISTINCT commit_hash, file_path FROM ch) h JOIN cc c ON c.hash = h.commit_hash) WHERE r = 1"""
    ),
    "git_co_change": with_views(_CO),
    "git_co_change_top": with_views(_CO + " ORDER BY jaccard DESC, file_a, file_b LIMIT 50"),
    "git_monthly_activity": with_views(
        """WITH m AS (SELECT DISTINCT hash, date_trunc('month', make_timestamp(authored_at * 1000))::DATE AS m FROM cc), hi AS (SELECT max(m) AS hi FROM m),
        span AS (SELECT unnest(generate_series(hi - INTERVAL 11 MONTH, hi::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM hi)
        SELECT strftime(span.m, '%Y-%m') AS month, count(DISTINCT hash) AS commits FROM span LEFT JOIN m ON m.m = span.m GROUP BY 1"""
    ),
}
