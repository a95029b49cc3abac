"""Reachability and risk: dead code, test coverage, hotspots, blast radius, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline import schemas as S
from strataline.operators import graph
from strataline.plans import starts
from strataline.tables import Tables, with_views

#: Places of entry points below the project, as SQL LIKE patterns: their top-level functions count as used.
ENTRY_PATHS = ("scripts/%", "bench/%", "%/main.%", "%/bin.%", "%/run.%", "%/cli/index.%")
# Weight of a hotspot by the coverage of its symbol
COVERAGE_WEIGHT = {"none": 1.0, "imported": 0.6, "called": 0.2}
# Marks of generated files in their path, and the note in the first 4 KB of their text
GENERATED_DIRS = ("mocks", "fakes", "__generated__")
GENERATED_PREFIXES, GENERATED_SUFFIX = ("fake_", "mock_"), "_mock"
GENERATED_EXTENSIONS = ("go", "ts", "tsx", "js", "jsx", "py")
GENERATED_NOTE = "Code generated.*DO NOT EDIT"
#: Test files as the blast radius sees them.
BLAST_TEST = r"\.test\.|\.spec\.|__tests__|^tests?/|/tests?/"


def generated_files(t: Tables) -> DataFrame:
    """(file_id) of files generated by their path or by a note in the first 4 KB of their text."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    extension = F.substring_index(name, ".", -1)
    bare = F.expr("substring(element_at(split(path, '/'), -1), 1, length(element_at(split(path, '/'), -1)) - length(substring_index(path, '.', -1)) - 1)")
    named = F.lit(False)
    for x in GENERATED_PREFIXES:
        named = named | (bare.startswith(x) & (F.length(bare) > len(x)))
    named = named | (bare.endswith(GENERATED_SUFFIX) & (F.length(bare) > len(GENERATED_SUFFIX)))
    placed = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, GENERATED_DIRS)))
    by_path = t.files.where(placed | (name.contains(".") & extension.isin(*GENERATED_EXTENSIONS) & named)).select(F.col("id").alias("file_id"))
    by_text = t.raw("documents").where(F.col("file_id").isNotNull() & F.substring("text", 1, 4096).rlike("(?i)" + GENERATED_NOTE)).select("file_id")
    return by_path.unionByName(by_text.join(t.files.select(F.col("id").alias("file_id")), "file_id", "left_semi")).distinct()


def imported_pairs(t: Tables) -> DataFrame:
    """(test_file_id, source_symbol_stable_id): exported symbols of files a test file imports, over any number of steps."""
    tests = t.files.where("is_test").select(F.col("id").alias("key"))
    edges = t.imports.select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"))
    seeds = edges.join(tests, edges.src == tests.key, "left_semi").select(F.col("src").alias("key"), F.col("dst").alias("id"))
    files = graph.reach(seeds, edges, ready=True).select(F.col("key").alias("test_file_id"), F.col("id").alias("file_id"))
    return files.join(open_symbols(t).select("file_id", F.col("stable_id").alias("source_symbol_stable_id")), "file_id").select("test_file_id", "source_symbol_stable_id").distinct()


def called_pairs(t: Tables) -> DataFrame:
    """(test_file_id, source_symbol_stable_id): symbols outside tests that a test's symbols call or are handed."""
    e = t.linked.where(F.col("kind").isin("calls", "passed_as") & F.col("source_test") & ~F.col("target_test"))
    return e.select(F.col("source_file_id").alias("test_file_id"), F.col("target_id").alias("source_symbol_stable_id")).distinct()


def test_links(t: Tables) -> DataFrame:
    """Test links; where a symbol is both imported and called by a test file, called holds."""
    rows = imported_pairs(t).withColumn("rank", F.lit(0)).unionByName(called_pairs(t).withColumn("rank", F.lit(1)))
    best = rows.groupBy("test_file_id", "source_symbol_stable_id").agg(F.max("rank").alias("rank"))
    return best.select("test_file_id", "source_symbol_stable_id", F.when(F.col("rank") == 1, "called").otherwise("imported").alias("confidence"))


def open_symbols(t: Tables) -> DataFrame:
    """Symbols outside tests that are exported themselves or by their parent."""
    parent = t.symbols.select(F.col("stable_id").alias("parent_id"), F.col("is_exported").alias("parent_exported"))
    return t.placed.where(~F.col("is_test")).join(parent, "parent_id", "left").where(F.col("is_exported") | F.coalesce("parent_exported", F.lit(False)))


def coverage(t: Tables) -> DataFrame:
    """(stable_id, coverage): the best confidence of each linked symbol.

    Which test links a symbol does not matter here, so all test files are one start: the
    table of links, whose size is tests times files, is never made.
    """
    edges = t.imports.select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"))
    tests = t.files.where("is_test").select(F.col("id").alias("src"))
    seeds = edges.join(tests, "src", "left_semi").select(F.lit(0).alias("key"), F.col("dst").alias("id"))
    files = graph.reach(seeds, edges, ready=True).select(F.col("id").alias("file_id"))
    imported = open_symbols(t).join(files, "file_id", "left_semi").select("stable_id", F.lit(0).alias("rank"))
    called = called_pairs(t).select(F.col("source_symbol_stable_id").alias("stable_id"), F.lit(1).alias("rank"))
    best = imported.unionByName(called).groupBy("stable_id").agg(F.max("rank").alias("rank"))
    return best.select("stable_id", F.when(F.col("rank") == 1, "called").otherwise("imported").alias("coverage"))


def live_roots(t: Tables, called: DataFrame, entry_paths: tuple[str, ...] = ENTRY_PATHS) -> DataFrame:
    """Symbols that are alive by themselves: exported, called by tests, entry points, components.

    ``entry_paths`` are compared with what follows the project, the path's first part.
    """
    p = t.placed.where(~F.col("is_test"))
    out = open_symbols(t).select("stable_id")
    top = p.where(F.col("kind").isin("function", "class"))
    entry = F.lit(False)
    below = F.lower(F.expr("substring(path, instr(path, '/') + 1)"))
    for like in entry_paths:
        entry = entry | below.like(like) | F.concat(F.lit("/"), below).like(like)
    out = out.unionByName(top.where(F.col("parent_id").isNull() & entry).select("stable_id"))
    out = out.unionByName(top.where(F.lower("path").endswith(".tsx") & F.col("name").rlike("^[A-Z]")).select("stable_id"))
    return out.unionByName(called.select(F.col("source_symbol_stable_id").alias("stable_id"))).distinct()


def dead_code(t: Tables, include_tests: bool = False, path: str | None = None, kind: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Symbols that no root reaches over liveness edges and that are not exported themselves."""
    roots = live_roots(t, called_pairs(t)).select(F.lit(0).alias("key"), F.col("stable_id").alias("id"))
    alive = graph.reach(roots, _walk(t, S.LIVENESS_KINDS, False), ready=True).select(F.col("id").alias("stable_id"))
    x = t.placed.where(~F.col("is_exported") & F.col("kind").isin(*S.DEAD_KINDS) & (F.col("name") != "constructor"))
    if not include_tests:
        x = x.where(~F.col("is_test"))
    if path:
        x = x.where(F.lower("path").contains(path.lower()))
    if kind:
        x = x.where(F.col("kind") == kind)
    if exclude is not None:
        x = x.join(exclude, "file_id", "left_anti")
    return x.join(alive, "stable_id", "left_anti").select("stable_id", "name", "qualified_name", "kind", "path", "line_start")


def internal_only(t: Tables, within: str, include_tests: bool = False) -> DataFrame:
    """Symbols under a path prefix without a caller from outside it; no caller at all counts."""
    p = t.placed
    inside = F.lower("path").startswith(within.lower())
    e = t.edges.where(F.col("kind").isin(*S.LIVENESS_KINDS)).select("source_id", "target_id").distinct()
    outside = e.join(p.where(~inside).select(F.col("stable_id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("stable_id"))
    x = p.where(inside & F.col("kind").isin(*S.DEAD_KINDS) & (F.col("name") != "constructor"))
    if not include_tests:
        x = x.where(~F.col("is_test"))
    return x.join(outside, "stable_id", "left_anti").select("stable_id", "name", "kind", "path", "line_start")


def commits_per_file(t: Tables) -> DataFrame:
    return t.changes.groupBy(F.col("file_path").alias("path")).agg(F.count_distinct("commit_hash").alias("commits"))


def hotspots(t: Tables, limit: int | None = 20, only: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Exported callables by callers x commits x coverage weight, the riskiest first."""
    fanin = t.edges.where(F.col("kind") == "calls").groupBy(F.col("target_id").alias("stable_id")).agg(F.count_distinct("source_id").alias("fanin"))
    x = t.placed.where(F.col("is_exported") & ~F.col("is_test") & F.col("kind").isin(*S.CALLABLE_KINDS))
    if exclude is not None:
        x = x.join(exclude, "file_id", "left_anti")
    x = x.join(fanin, "stable_id").join(coverage(t), "stable_id", "left").join(commits_per_file(t), "path", "left")
    x = x.withColumn("coverage", F.coalesce("coverage", F.lit("none"))).withColumn("commits", F.coalesce("commits", F.lit(0)))
    weight = F.lit(1.0)
    for k, v in COVERAGE_WEIGHT.items():
        weight = F.when(F.col("coverage") == k, F.lit(v)).otherwise(weight)
    if only:
        x = x.where(F.col("coverage") == only)
    out = x.select("stable_id", "name", "kind", "path", "line_start", "fanin", "commits", "coverage", F.round(F.col("fanin") * F.col("commits") * weight, 6).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "stable_id").limit(limit)


def hot_fragile(t: Tables, limit: int | None = 20) -> DataFrame:
    """Files by commits x untested callables, with the first three untested names by line."""
    tested = called_pairs(t).select(F.col("source_symbol_stable_id").alias("stable_id")).distinct()
    s = t.placed.where(F.col("is_exported") & ~F.col("is_test") & F.col("kind").isin(*S.CALLABLE_KINDS))
    s = s.join(tested.withColumn("tested", F.lit(True)), "stable_id", "left").withColumn("tested", F.coalesce("tested", F.lit(False)))
    # the callables of one file are as many as its text holds
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.when(~F.col("tested"), F.struct("line_start", "id", "name")))), 1, 3), lambda x: x["name"])
    agg = s.groupBy("path").agg(F.count(F.lit(1)).alias("symbol_count"), F.count_if(~F.col("tested")).alias("untested_count"), F.array_join(first, ",").alias("preview"))
    out = agg.where(F.col("untested_count") > 0).join(commits_per_file(t), "path").withColumn("fragility", F.col("commits") * F.col("untested_count"))
    out = out.select("path", "commits", "symbol_count", "untested_count", "preview", "fragility")
    return out if limit is None else out.orderBy(F.desc("fragility"), F.desc("commits"), "path").limit(limit)


def untested(t: Tables) -> DataFrame:
    """Exported callables outside tests that no test calls."""
    tested = called_pairs(t).select(F.col("source_symbol_stable_id").alias("stable_id"))
    x = t.placed.where(F.col("is_exported") & ~F.col("is_test") & F.col("kind").isin(*S.CALLABLE_KINDS))
    return x.join(tested, "stable_id", "left_anti").select("stable_id", "name", "kind", "path", "line_start")


def busiest(t: Tables, callers: bool = True) -> str | None:
    """The symbol with most callers (or callees); ties go to the smaller id. A start for traversals."""
    own, other = ("target_id", "source_id") if callers else ("source_id", "target_id")
    ids = t.symbols.select(F.col("stable_id").alias(own))
    e = t.edges.where(F.col("kind") == "calls").join(ids, own, "left_semi")
    row = e.groupBy(own).agg(F.count_distinct(other).alias("n")).orderBy(F.desc("n"), own).first()
    return row[own] if row else None


def _walk(t: Tables, kinds, inbound: bool) -> DataFrame:
    a, b = ("target_id", "source_id") if inbound else ("source_id", "target_id")
    return t.steps.where(F.col("kind").isin(*kinds)).select(F.col(a).alias("src"), F.col(b).alias("dst"))


def dependencies(t: Tables, start: str, direction: str = "upstream", depth: int = 3) -> DataFrame:
    """Nodes within ``depth`` steps: upstream are callers, downstream callees; unknown ids are kept."""
    kinds = [k for k in S.EDGE_KINDS if k != "contains"]
    seeds = t.spark.createDataFrame([("q", start)], "key string, id string")
    r = graph.reach(seeds, _walk(t, kinds, direction == "upstream"), depth, ready=True).where(F.col("depth") > 0)
    names = t.placed.select(F.col("stable_id").alias("id"), "name", "kind", "path")
    return r.join(names, "id", "left").select(F.col("id").alias("stable_id"), "depth", F.coalesce("name", F.lit("<unknown>")).alias("name"), "kind", "path")


def blast_radius(t: Tables, start: str, depth: int = 5, include_tests: bool = True) -> DataFrame:
    """What a change may break: callers over ``depth`` steps; members of a class are seeds at 1 and left out."""
    kinds = [k for k in S.EDGE_KINDS if k != "contains"]
    kind = t.symbols.where(F.col("stable_id") == start).select("kind").first()
    seeds = t.spark.createDataFrame([("q", start, 0)], "key string, id string, depth int")
    members = t.edges.where((F.col("kind") == "contains") & (F.col("source_id") == start)).select(F.col("target_id").alias("id")).distinct()
    typed = kind is not None and kind["kind"] in ("class", "interface", "type")
    if typed:
        seeds = seeds.unionByName(members.select(F.lit("q").alias("key"), "id", F.lit(1).alias("depth")))
    r = graph.reach(seeds, _walk(t, kinds, True), depth, ready=True).where(F.col("depth") > 0)
    if typed:
        r = r.join(members, "id", "left_anti")
    x = r.join(t.placed.select(F.col("stable_id").alias("id"), "name", "path", "is_test"), "id")
    if not include_tests:
        x = x.where(~F.col("is_test"))
    return x.select(F.col("id").alias("stable_id"), "name", "path", "depth", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("tier"), F.col("path").rlike(BLAST_TEST).alias("affected_test"))


def trace(t: Tables, source: str, target: str, max_paths: int = 5, max_depth: int = 10) -> DataFrame:
    """Shortest simple paths over call-like edges, over all kinds if there is none."""
    first = graph.simple_paths(_walk(t, S.FAST_TRACE_KINDS, False), source, target, max_paths, max_depth)
    return first if first.limit(1).count() else graph.simple_paths(_walk(t, S.EDGE_KINDS, False), source, target, max_paths, max_depth)


def flow_roots(t: Tables) -> DataFrame:
    """Exported functions and methods outside tests that nothing calls."""
    called = t.edges.where(F.col("kind") == "calls").select(F.col("target_id").alias("stable_id"))
    x = t.placed.where(F.col("is_exported") & ~F.col("is_test") & F.col("kind").isin(*S.CALLABLE_KINDS))
    return x.join(called, "stable_id", "left_anti").select("stable_id", "name", "path")


def flows(t: Tables, depth: int = 5) -> DataFrame:
    """(root, stable_id, step): what each flow root reaches by calls within ``depth``; chains of two and more."""
    seeds = flow_roots(t).select(F.col("stable_id").alias("key"), F.col("stable_id").alias("id"))
    r = graph.reach(seeds, _walk(t, ("calls",), False), depth, ready=True)
    known = r.join(t.symbols.select(F.col("stable_id").alias("id")), "id", "left_semi")
    long = known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select("key")
    return known.join(long, "key", "left_semi").select(F.col("key").alias("root"), F.col("id").alias("stable_id"), F.col("depth").alias("step"))


def _q(f, **kw):
    return lambda spark, d: f(Tables(spark, d), **kw)


def _from_busiest(f, callers=True, **kw):
    def run(spark, d):
        t = Tables(spark, d)
        return f(t, busiest(t, callers) or "", **kw)

    return run


def trace_to_busiest(spark, d):
    """Paths to the busiest symbol from the smallest of the nodes furthest from it (up to 4 steps)."""
    t = Tables(spark, d)
    goal = busiest(t) or ""
    seeds = spark.createDataFrame([("q", goal)], "key string, id string")
    row = graph.reach(seeds, _walk(t, S.FAST_TRACE_KINDS, True), 4, ready=True).orderBy(F.desc("depth"), "id").first()
    return trace(t, row["id"], goal, max_depth=6).select(F.concat_ws(">", "path").alias("path"), "length")


QUERIES = {
    "risk_generated_files": _q(generated_files),
    "risk_test_links": _q(test_links),
    "risk_dead_code": _q(dead_code),
    "risk_dead_code_stats": lambda s, d: dead_code(Tables(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "risk_dead_code_handwritten": lambda s, d: dead_code(t := Tables(s, d), exclude=generated_files(t)),
    "risk_internal_only": lambda s, d: internal_only(t := Tables(s, d), starts.largest_project(t) + "/"),
    "risk_hotspots": _q(hotspots, limit=None),
    "risk_hotspots_top": _q(hotspots),
    "risk_hot_fragile": _q(hot_fragile, limit=None),
    "risk_untested": _q(untested),
    "graph_dependencies_up": _from_busiest(dependencies, direction="upstream"),
    "graph_dependencies_down": _from_busiest(dependencies, callers=False, direction="downstream"),
    "graph_blast_radius": _from_busiest(blast_radius),
    "graph_trace": trace_to_busiest,
    "graph_flow_roots": _q(flow_roots),
    "graph_flows": _q(flows),
}

_KINDS = lambda ks: "(" + ", ".join(f"'{k}'" for k in ks) + ")"
_LINKS = f"""WITH called AS (SELECT DISTINCT a.file_id AS test_file_id, b.stable_id FROM ec e JOIN sf a ON a.stable_id = e.source_id JOIN sf b ON b.stable_id = e.target_id
  WHERE e.kind IN ('calls', 'passed_as') AND a.is_test AND NOT b.is_test),
walk(test_id, file_id) AS (SELECT i.source_file_id, i.target_file_id FROM im i JOIN fc f ON f.id = i.source_file_id WHERE f.is_test
  UNION SELECT w.test_id, i.target_file_id FROM walk w JOIN im i ON i.source_file_id = w.file_id),
imported AS (SELECT DISTINCT w.test_id AS test_file_id, s.stable_id FROM walk w JOIN sf s ON s.file_id = w.file_id LEFT JOIN sc p ON p.stable_id = s.parent_id
  WHERE NOT s.is_test AND (s.is_exported OR p.is_exported)),
links AS (SELECT test_file_id, stable_id, max(r) AS r FROM (SELECT *, 1 AS r FROM called UNION ALL SELECT *, 0 FROM imported) GROUP BY ALL),
per_file AS (SELECT file_path AS path, count(DISTINCT commit_hash) AS commits FROM ch GROUP BY 1),
gen AS (SELECT id AS file_id FROM fc WHERE path LIKE 'mocks/%' OR path LIKE 'fakes/%' OR path LIKE '\\_\\_generated\\_\\_/%' ESCAPE '\\' OR contains(path, '/mocks/') OR contains(path, '/fakes/') OR contains(path, '/__generated__/')
    OR (list_contains(['go', 'ts', 'tsx', 'js', 'jsx', 'py'], regexp_extract(path, '[.]([^.]*)$', 1))
      AND regexp_matches(regexp_extract(path, '[^/]*$'), '^(fake_.+|mock_.+|.+_mock)[.][a-z]+$')) UNION
  SELECT d.file_id FROM documents d JOIN fc f ON f.id = d.file_id WHERE regexp_matches(lower(substr(d.text, 1, 4096)), 'code generated[^\n]*do not edit')),
roots AS (SELECT s.stable_id FROM sf s LEFT JOIN sc p ON p.stable_id = s.parent_id WHERE NOT s.is_test AND (s.is_exported OR p.is_exported)
  UNION SELECT stable_id FROM called
  UNION SELECT stable_id FROM sf WHERE NOT is_test AND parent_id IS NULL AND kind IN ('function', 'class') AND (regexp_matches(lower(path), '^[^/]*/(scripts|bench)/') OR regexp_matches(lower(path), '/(main|bin|run)[.][^/]*$') OR regexp_matches(lower(path), '/cli/index[.][^/]*$'))
  UNION SELECT stable_id FROM sf WHERE NOT is_test AND kind IN ('function', 'class') AND lower(path) LIKE '%.tsx' AND regexp_matches(name, '^[A-Z]')),
live(stable_id) AS (SELECT stable_id FROM roots UNION SELECT e.target_id FROM ec e JOIN live l ON l.stable_id = e.source_id WHERE e.kind IN {_KINDS(S.LIVENESS_KINDS)}),
busy AS (SELECT target_id AS id FROM ec WHERE kind = 'calls' AND target_id IN (SELECT stable_id FROM sc) GROUP BY 1 ORDER BY count(DISTINCT source_id) DESC, target_id LIMIT 1),
busy_caller AS (SELECT source_id AS id FROM ec WHERE kind = 'calls' AND source_id IN (SELECT stable_id FROM sc) GROUP BY 1 ORDER BY count(DISTINCT target_id) DESC, source_id LIMIT 1),
dead AS (SELECT stable_id, name, qualified_name, kind, path, line_start, file_id FROM sf WHERE NOT is_exported AND NOT is_test AND kind IN {_KINDS(S.DEAD_KINDS)} AND name <> 'constructor'
  AND stable_id NOT IN (SELECT stable_id FROM live WHERE stable_id IS NOT NULL)),
callable AS (SELECT * FROM sf WHERE is_exported AND NOT is_test AND kind IN {_KINDS(S.CALLABLE_KINDS)}),
hot AS (SELECT s.stable_id, s.name, s.kind, s.path, s.line_start, x.fanin, coalesce(c.commits, 0) AS commits,
    CASE WHEN l.r = 1 THEN 'called' WHEN l.r = 0 THEN 'imported' ELSE 'none' END AS coverage,
    round(x.fanin * coalesce(c.commits, 0) * CASE WHEN l.r = 1 THEN 0.2 WHEN l.r = 0 THEN 0.6 ELSE 1.0 END::DOUBLE, 6) AS score
  FROM callable s JOIN (SELECT target_id, count(DISTINCT source_id) AS fanin FROM ec WHERE kind = 'calls' GROUP BY 1) x ON x.target_id = s.stable_id
  LEFT JOIN (SELECT stable_id, max(r) AS r FROM links GROUP BY 1) l ON l.stable_id = s.stable_id LEFT JOIN per_file c ON c.path = s.path),
fragile AS (SELECT s.path, any_value(c.commits) AS commits, count(*) AS symbol_count, count(*) FILTER (WHERE k.stable_id IS NULL) AS untested_count,
    array_to_string(list_transform(list_slice(list_sort(list({{'line': s.line_start, 'id': s.id, 'name': s.name}}) FILTER (WHERE k.stable_id IS NULL)), 1, 3), lambda x: x.name), ',') AS preview
  FROM callable s JOIN per_file c ON c.path = s.path LEFT JOIN (SELECT DISTINCT stable_id FROM called) k ON k.stable_id = s.stable_id GROUP BY s.path)
"""


def _walk_sql(kinds, inbound: bool, depth: int, extra: str = "") -> str:
    a, b = ("target_id", "source_id") if inbound else ("source_id", "target_id")
    return f""", seed AS (SELECT id, 0 AS depth FROM busy {extra}),
    steps(id, depth) AS (SELECT id, depth FROM seed UNION SELECT e.{b}, s.depth + 1 FROM steps s JOIN ec e ON e.{a} = s.id WHERE s.depth < {depth} AND e.kind IN {_KINDS(kinds)} AND e.{a} <> e.{b}),
    near AS (SELECT id, min(depth) AS depth FROM steps GROUP BY 1)"""


_NO_CONTAINS = [k for k in S.EDGE_KINDS if k != "contains"]
_sql = lambda tail: with_views(_LINKS + tail, recursive=True)
_DEPS = " SELECT n.id AS stable_id, n.depth, coalesce(s.name, '<unknown>') AS name, s.kind, s.path FROM near n LEFT JOIN sf s ON s.stable_id = n.id WHERE n.depth > 0"
_CLASS = "(SELECT 1 FROM sc JOIN busy ON sc.stable_id = busy.id WHERE sc.kind IN ('class', 'interface', 'type'))"

ORACLE = {
    "risk_generated_files": _sql("SELECT file_id FROM gen"),
    "risk_test_links": _sql("SELECT test_file_id, stable_id AS source_symbol_stable_id, CASE r WHEN 1 THEN 'called' ELSE 'imported' END AS confidence FROM links"),
    "risk_dead_code": _sql("SELECT * EXCLUDE (file_id) FROM dead"),
    "risk_dead_code_stats": _sql("SELECT kind, count(*) AS n FROM dead GROUP BY 1"),
    "risk_dead_code_handwritten": _sql("SELECT * EXCLUDE (file_id) FROM dead WHERE file_id NOT IN (SELECT file_id FROM gen)"),
    "risk_internal_only": _sql(
        f"""SELECT stable_id, name, kind, path, line_start FROM sf WHERE starts_with(lower(path), lower((SELECT project FROM bp)) || '/') AND NOT is_test AND kind IN {_KINDS(S.DEAD_KINDS)} AND name <> 'constructor'
        AND NOT EXISTS (SELECT 1 FROM ec e JOIN sf o ON o.stable_id = e.source_id WHERE e.target_id = sf.stable_id AND e.kind IN {_KINDS(S.LIVENESS_KINDS)} AND NOT starts_with(lower(o.path), lower((SELECT project FROM bp)) || '/'))"""
    ),
    "risk_hotspots": _sql("SELECT * FROM hot"),
    "risk_hotspots_top": _sql("SELECT * FROM hot ORDER BY score DESC, stable_id LIMIT 20"),
    "risk_hot_fragile": _sql("SELECT *, commits * untested_count AS fragility FROM fragile WHERE untested_count > 0"),
    "risk_untested": _sql("SELECT stable_id, name, kind, path, line_start FROM callable WHERE stable_id NOT IN (SELECT stable_id FROM called)"),
    "graph_dependencies_up": _sql(_walk_sql(_NO_CONTAINS, True, 3) + _DEPS),
    "graph_dependencies_down": _sql(_walk_sql(_NO_CONTAINS, False, 3).replace("FROM busy ", "FROM busy_caller ") + _DEPS),
    "graph_blast_radius": _sql(
        ", members AS (SELECT DISTINCT e.target_id AS id FROM ec e JOIN busy ON e.source_id = busy.id WHERE e.kind = 'contains' AND EXISTS " + _CLASS + ")"
        + _walk_sql(_NO_CONTAINS, True, 5, "UNION ALL SELECT id, 1 FROM members")
        + f""" SELECT n.id AS stable_id, s.name, s.path, n.depth, CASE n.depth WHEN 1 THEN 'direct' ELSE 'transitive' END AS tier, regexp_matches(s.path, '{BLAST_TEST}') AS affected_test
        FROM near n JOIN sf s ON s.stable_id = n.id WHERE n.depth > 0 AND n.id NOT IN (SELECT id FROM members)"""
    ),
    "graph_trace": _sql(
        _walk_sql(S.FAST_TRACE_KINDS, True, 4)
        + f""", far AS (SELECT id FROM near ORDER BY depth DESC, id LIMIT 1), hop AS (SELECT DISTINCT source_id AS a, target_id AS b FROM ec WHERE kind IN {_KINDS(S.FAST_TRACE_KINDS)} AND source_id <> target_id),
        back(id, n) AS (SELECT id, 0 FROM busy UNION SELECT h.a, k.n + 1 FROM back k JOIN hop h ON h.b = k.id WHERE k.n < 6), togo AS (SELECT id, min(n) AS n FROM back GROUP BY 1),
        way(path, tip, n) AS (SELECT [id], id, 0 FROM far UNION ALL SELECT list_append(w.path, h.b), h.b, w.n + 1 FROM way w JOIN hop h ON h.a = w.tip JOIN togo g ON g.id = h.b
          WHERE w.n + 1 + g.n <= 6 AND NOT list_contains(w.path, h.b) AND w.tip <> (SELECT id FROM busy))
        SELECT array_to_string(path, '>') AS path, n AS length FROM way WHERE tip = (SELECT id FROM busy) AND n > 0 ORDER BY n, way.path LIMIT 5"""
    ),
    "graph_flow_roots": _sql("SELECT stable_id, name, path FROM callable WHERE stable_id NOT IN (SELECT target_id FROM ec WHERE kind = 'calls' AND target_id IS NOT NULL)"),
    "graph_flows": _sql(
        """, fr AS (SELECT stable_id FROM callable WHERE stable_id NOT IN (SELECT target_id FROM ec WHERE kind = 'calls' AND target_id IS NOT NULL)),
        fw(root, id, step) AS (SELECT stable_id, stable_id, 0 FROM fr UNION SELECT w.root, e.target_id, w.step + 1 FROM fw w JOIN ec e ON e.source_id = w.id WHERE e.kind = 'calls' AND w.step < 5),
        fl AS (SELECT root, id, min(step) AS step FROM fw WHERE id IN (SELECT stable_id FROM sc) GROUP BY 1, 2)
        SELECT root, id AS stable_id, step FROM fl WHERE root IN (SELECT root FROM fl GROUP BY 1 HAVING count(*) >= 2)"""
    ),
}
