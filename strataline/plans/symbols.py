"""Symbol lookup and search, listings, and relational questions over files and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline import schemas as S
from strataline.operators import relational as R
from strataline.operators.skew import hot_keys, lookup
from strataline.plans import starts
from strataline.tables import Tables, with_views


def dependents(t: Tables, with_field_access: bool = False) -> DataFrame:
    """(stable_id, dependent_count): distinct sources of edges into each symbol."""
    e = t.edges if with_field_access else t.edges.where(F.col("kind") != "field_access")
    return e.groupBy(F.col("target_id").alias("stable_id")).agg(F.count_distinct("source_id").alias("dependent_count"))


def hydrate(t: Tables, rows: DataFrame) -> DataFrame:
    """Symbol results: the rows with their dependent count (0 if none) and a usage count of 0."""
    x = rows.join(dependents(t), "stable_id", "left")
    return x.select(
        "stable_id", "name", "qualified_name", "kind", "path", "line_start", "is_exported", F.lit(0).alias("usage_count"), F.coalesce("dependent_count", F.lit(0)).alias("dependent_count")
    )


def search_exact(t: Tables, name: str, kind: str | None = None, include_tests: bool = False, limit: int = 20) -> DataFrame:
    x = t.placed.where(F.col("name") == name)
    x = x.where(F.col("kind") == kind) if kind else x
    x = x if include_tests else x.where(~F.col("is_test"))
    return hydrate(t, x).orderBy(F.desc("is_exported"), "name", "stable_id").limit(limit)


def names_by_kinds(t: Tables, names: list[str], kinds: list[str]) -> DataFrame:
    """Symbols outside tests with one of the names and one of the kinds."""
    return t.placed.where(F.col("name").isin(*names) & F.col("kind").isin(*kinds) & ~F.col("is_test")).select("stable_id", "name", "kind", "path")


def top_exported(t: Tables, limit: int | None = 8) -> DataFrame:
    x = hydrate(t, t.placed.where(F.col("is_exported") & ~F.col("is_test") & F.col("kind").isin(*S.EXPORTED_KINDS)))
    return x if limit is None else x.orderBy(F.desc("dependent_count"), "name", "stable_id").limit(limit)


def call_sites(t: Tables, inbound: bool = True, kind: str | None = None) -> DataFrame:
    """One row per edge at its symbol, with the other end and its file; multiplicity is kept."""
    own, other = ("target_id", "source_id") if inbound else ("source_id", "target_id")
    e = t.edges if kind is None else t.edges.where(F.col("kind") == kind)
    p = t.placed.select(F.col("stable_id").alias(other), F.col("name").alias("other_name"), F.col("kind").alias("other_kind"), "path", "line_start")
    x = lookup(e.withColumnRenamed("kind", "edge_kind"), p, other, "inner", hot_keys(e, other))
    return x.select(F.col(own).alias("stable_id"), F.col(other).alias("other_id"), "other_name", "other_kind", "path", "line_start", F.col("line").alias("call_line"), "edge_kind")


def file_outline(t: Tables) -> DataFrame:
    """Symbols of every file with their place in it, in order of line."""
    return R.rank_within(t.placed, ["path"], ["line_start", "id"], "position").select("path", "position", "stable_id", "name", "kind", "line_start", "line_end")


def files_listing(t: Tables, include_tests: bool = True) -> DataFrame:
    f = t.files if include_tests else t.files.where(~F.col("is_test"))
    n = t.symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("symbols"))
    return f.join(n, "id", "left").select("path", "language", "size_bytes", "is_test", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def language_stats(t: Tables) -> DataFrame:
    return t.files.where(F.col("language").isNotNull()).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def status(t: Tables) -> DataFrame:
    """Row counts and the age class of the index, one row per figure; now is the newest indexed_at."""
    names = {"files": t.files, "symbols": t.symbols, "edges": t.edges, "commits": t.commits, "file_changes": t.changes}
    out = None
    for k, df in names.items():
        one = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(k).alias("figure"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def health(indexed_at, now):
    """fresh under an hour, stale under a day, else outdated (epoch milliseconds)."""
    age = (now - indexed_at) / 3_600_000
    return F.when(age < 1, "fresh").when(age < 24, "stale").otherwise("outdated")


def freshness(t: Tables) -> DataFrame:
    """Age class of each file's index entry, measured from the newest one."""
    now = t.files.agg(F.max("indexed_at").alias("now"))
    x = t.files.crossJoin(F.broadcast(now)).withColumn("health", health(F.col("indexed_at"), F.col("now")))  # one row beside each file
    return x.groupBy("health").agg(F.count(F.lit(1)).alias("files"))


def ranked(t: Tables) -> DataFrame:
    """Of the symbols of one name the best: exported, top level, weighty kind, short qualified name."""
    weight = F.lit(9)
    for i, k in enumerate(("class", "interface", "function", "type", "method", "enum", "variable", "module", "property")):
        weight = F.when(F.col("kind") == k, i).otherwise(weight)
    order = F.struct((~F.col("is_exported")).cast("int"), F.col("parent_id").isNotNull().cast("int"), weight, F.length("qualified_name"), F.col("stable_id"))
    row = F.struct("stable_id", "qualified_name", "kind", "path")
    return t.placed.groupBy("name").agg(F.count(F.lit(1)).alias("candidates"), F.min_by(row, order).alias("r")).select("name", "candidates", "r.*")


def resolve(t: Tables, query: str) -> DataFrame:
    """Symbol for a query: ``file:name``, else the exact name, else a part of a qualified name; best first of its tier."""
    x = t.placed
    tiers = []
    file, sep, name = query.rpartition(":")
    if sep and file and not file.endswith(":"):
        tiers.append(x.where(F.lower("path").contains(file.lower()) & (F.col("name") == name)).withColumn("tier", F.lit(0)))
    tiers.append(x.where(F.col("name") == query).withColumn("tier", F.lit(1)))
    tiers.append(x.where(F.lower("qualified_name").contains(query.lower())).withColumn("tier", F.lit(2)))
    out = tiers[0]
    for y in tiers[1:]:
        out = out.unionByName(y)
    order = ["tier", F.desc("is_exported"), F.col("parent_id").isNotNull(), F.length("qualified_name"), "stable_id"]
    return out.orderBy(*order).limit(1).select("stable_id", "name", "qualified_name", "kind", "path", "tier")


def natural_keys(t: Tables) -> DataFrame:
    """Stable ids recomputed from path, kind and qualified name, beside the stored ones."""
    made = F.substring(F.sha2(F.concat_ws(":", "path", "kind", "qualified_name"), 256), 1, 32)
    return t.placed.select("stable_id", made.alias("computed_id"), (made == F.col("stable_id")).alias("equal"))


def overview(t: Tables, limit: int = 10) -> DataFrame:
    """Per symbol: how many symbols it uses and is used by, and how many edges, over all kinds but contains."""
    e = t.edges.where(F.col("kind") != "contains")
    out = e.groupBy(F.col("source_id").alias("stable_id")).agg(F.count_distinct("target_id").alias("uses"), F.count(F.lit(1)).alias("sites"))
    into = dependents(t, True)
    return t.symbols.select("stable_id").join(out, "stable_id", "left").join(into, "stable_id", "left").na.fill(0)


def enclosing(t: Tables) -> DataFrame:
    """The smallest symbol around the place of each edge that has a file and a line."""
    at = t.edges.where(F.col("file_id").isNotNull() & F.col("line").isNotNull()).select("id", "file_id", F.col("line").alias("at"))
    return R.smallest_enclosing(at, t.symbols.select("file_id", "stable_id", "line_start", "line_end"), "file_id", "at", "line_start", "line_end", "stable_id", ["id"])


def _q(f, **kw):
    return lambda spark, d: f(Tables(spark, d), **kw)


QUERIES = {
    "symbols_search_exact": lambda s, d: search_exact(t := Tables(s, d), (starts.common_names(t) or [""])[0]),
    "symbols_names_by_kinds": lambda s, d: names_by_kinds(t := Tables(s, d), starts.common_names(t), ["function", "method"]),
    "symbols_top_exported": _q(top_exported),
    "symbols_hydrated": _q(top_exported, limit=None),
    "symbols_callers": _q(call_sites, inbound=True, kind="calls"),
    "symbols_callees": _q(call_sites, inbound=False),
    "symbols_outline": _q(file_outline),
    "symbols_files": _q(files_listing),
    "symbols_languages": _q(language_stats),
    "symbols_status": _q(status),
    "symbols_freshness": _q(freshness),
    "symbols_ranked": _q(ranked),
    "symbols_resolve": lambda s, d: resolve(t := Tables(s, d), starts.placed_name(t)),
    "symbols_natural_keys": _q(natural_keys),
    "symbols_overview": _q(overview),
    "symbols_enclosing": _q(enclosing),
    "symbols_file_imports": lambda s, d: Tables(s, d).imports,
}

_DEP = "(SELECT target_id AS stable_id, count(DISTINCT source_id) AS dependent_count FROM ec WHERE kind <> 'field_access' GROUP BY 1)"
_HYD = f"""SELECT s.stable_id, s.name, s.qualified_name, s.kind, s.path, s.line_start, s.is_exported, 0 AS usage_count, coalesce(d.dependent_count, 0) AS dependent_count
FROM sf s LEFT JOIN {_DEP} d ON d.stable_id = s.stable_id WHERE """
_TOP = _HYD + f"s.is_exported AND NOT s.is_test AND s.kind IN {tuple(S.EXPORTED_KINDS)}"
_SITES = """SELECT e.{own} AS stable_id, e.{other} AS other_id, s.name AS other_name, s.kind AS other_kind, s.path, s.line_start, e.line AS call_line, e.kind AS edge_kind
FROM ec e JOIN sf s ON s.stable_id = e.{other}"""

ORACLE = {
    "symbols_search_exact": with_views(_HYD + "s.name = (SELECT name FROM nm WHERE nth = 1) AND NOT s.is_test ORDER BY s.is_exported DESC, s.name, s.stable_id LIMIT 20"),
    "symbols_names_by_kinds": with_views("SELECT stable_id, name, kind, path FROM sf WHERE name IN (SELECT name FROM nm) AND kind IN ('function', 'method') AND NOT is_test"),
    "symbols_top_exported": with_views(_TOP + " ORDER BY dependent_count DESC, s.name, s.stable_id LIMIT 8"),
    "symbols_hydrated": with_views(_TOP),
    "symbols_callers": with_views(_SITES.format(own="target_id", other="source_id") + " WHERE e.kind = 'calls'"),
    "symbols_callees": with_views(_SITES.format(own="source_id", other="target_id")),
    "symbols_outline": with_views("SELECT path, row_number() OVER (PARTITION BY path ORDER BY line_start, id) AS position, stable_id, name, kind, line_start, line_end FROM sf"),
    "symbols_files": with_views("SELECT path, language, size_bytes, is_test, coalesce(n, 0) AS symbols FROM fc LEFT JOIN (SELECT file_id, count(*) AS n FROM sc GROUP BY 1) x ON x.file_id = fc.id"),
    "symbols_languages": with_views("SELECT language, count(*) AS files FROM fc WHERE language IS NOT NULL GROUP BY 1"),
    "symbols_status": with_views(" UNION ALL ".join(f"SELECT '{k}' AS figure, count(*) AS value FROM {v}" for k, v in {"files": "fc", "symbols": "sc", "edges": "ec", "commits": "cc", "file_changes": "ch"}.items())),
    "symbols_freshness": with_views(
        """SELECT CASE WHEN age < 1 THEN 'fresh' WHEN age < 24 THEN 'stale' ELSE 'outdated' END AS health, count(*) AS files
        FROM (SELECT ((SELECT max(indexed_at) FROM fc) - indexed_at) / 3600000 AS age FROM fc) GROUP BY 1"""
    ),
    "symbols_ranked": with_views(
        """SELECT name, n AS candidates, stable_id, qualified_name, kind, path FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY NOT is_exported, parent_id IS NOT NULL,
        coalesce(list_position(['class', 'interface', 'function', 'type', 'method', 'enum', 'variable', 'module', 'property'], kind), 10), length(qualified_name), stable_id) AS r FROM sf) WHERE r = 1"""
    ),
    "symbols_resolve": with_views(
        """WITH x AS (SELECT sf.*, 0 AS tier FROM sf, pn WHERE contains(lower(path), lower(pn.file)) AND sf.name = pn.name UNION ALL SELECT sf.*, 1 FROM sf, pn WHERE sf.name = pn.file || ':' || pn.name
        UNION ALL SELECT sf.*, 2 FROM sf, pn WHERE contains(lower(qualified_name), lower(pn.file || ':' || pn.name)))
        SELECT stable_id, name, qualified_name, kind, path, tier FROM x ORDER BY tier, is_exported DESC, parent_id IS NOT NULL, length(qualified_name), stable_id LIMIT 1"""
    ),
    "symbols_natural_keys": with_views("SELECT stable_id, substr(sha256(path || ':' || kind || ':' || qualified_name), 1, 32) AS computed_id, substr(sha256(path || ':' || kind || ':' || qualified_name), 1, 32) = stable_id AS equal FROM sf"),
    "symbols_overview": with_views(
        """SELECT s.stable_id, coalesce(a.uses, 0) AS uses, coalesce(a.sites, 0) AS sites, coalesce(b.n, 0) AS dependent_count FROM sc s
        LEFT JOIN (SELECT source_id, count(DISTINCT target_id) AS uses, count(*) AS sites FROM ec WHERE kind <> 'contains' GROUP BY 1) a ON a.source_id = s.stable_id
        LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS n FROM ec GROUP BY 1) b ON b.target_id = s.stable_id"""
    ),
    "symbols_enclosing": with_views(
        """SELECT id, stable_id FROM (SELECT e.id, s.stable_id, row_number() OVER (PARTITION BY e.id ORDER BY s.line_end - s.line_start, s.stable_id) AS r
        FROM ec e JOIN sc s ON s.file_id = e.file_id AND e.line BETWEEN s.line_start AND s.line_end) WHERE r = 1"""
    ),
    "symbols_file_imports": with_views("SELECT * FROM im"),
}
