"""Compound answers: details of a symbol or file, dependency rows, coverage, routes, searches over projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline import schemas as S
from strataline.functions.text import sanitize
from strataline.operators import graph
from strataline.plans import risk, search, structure, symbols
from strataline.tables import Tables, with_views

_NO_CONTAINS = [k for k in S.EDGE_KINDS if k != "contains"]


def dependency_rows(t: Tables, start: str, direction: str = "upstream") -> DataFrame:
    """(stable_id, name, kind, path, edge_kind, confidence): direct neighbours with the kind of the first edge to each.

    Of several edges to one neighbour the first of the enumeration's kinds counts, then the
    smaller edge id; an end that is no symbol has no row.
    """
    own, other = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    order = F.array_position(F.array(*map(F.lit, _NO_CONTAINS)), F.col("kind"))
    e = t.edges.where((F.col(own) == start) & (F.col(other) != start) & F.col("kind").isin(*_NO_CONTAINS))
    first = e.groupBy(F.col(other).alias("stable_id")).agg(F.min_by("kind", F.struct(order, F.col("id"))).alias("edge_kind"))
    return t.placed.select("stable_id", "name", "kind", "path").join(first, "stable_id").withColumn("confidence", F.lit("resolved"))


def dependency_stats(t: Tables, start: str, direction: str = "upstream", depth: int = 3) -> DataFrame:
    """(depth, nodes, files): how much lies at each distance."""
    r = risk.dependencies(t, start, direction, depth)
    return r.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("path").alias("files"))


def blast_tests(t: Tables, start: str, depth: int = 5) -> DataFrame:
    """(path, tests, deepest): test files a change may break, with the affected symbols in each."""
    b = risk.blast_radius(t, start, depth).where("affected_test")
    return b.groupBy("path").agg(F.count(F.lit(1)).alias("tests"), F.max("depth").alias("deepest"))


def test_coverage(t: Tables, start: str) -> DataFrame:
    """(path, confidence): test files linked with a symbol; imported before called, then by path."""
    links = risk.test_links(t).where(F.col("source_symbol_stable_id") == start)
    f = t.files.select(F.col("id").alias("test_file_id"), "path")
    return links.join(f, "test_file_id").select("path", "confidence").orderBy(F.desc("confidence"), "path")


def dead_by_file(t: Tables) -> DataFrame:
    return risk.dead_code(t).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def source_slice(t: Tables, ids: DataFrame) -> DataFrame:
    """(stable_id, source): the lines of each symbol of ``ids`` (stable_id), as far as the stored text reaches."""
    docs = t.raw("documents").where((F.col("doc_kind") == "source_file") & F.col("file_id").isNotNull()).select("file_id", "text")
    s = t.symbols.join(ids.select("stable_id").distinct(), "stable_id", "left_semi").select("stable_id", "file_id", "line_start", "line_end")
    lines = F.slice(F.split("text", "\n"), F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0)))
    return s.where(F.col("line_start") > 0).join(docs, "file_id").select("stable_id", F.array_join(lines, "\n").alias("source")).distinct()


def symbol_detail(t: Tables, start: str) -> dict[str, DataFrame]:
    """A symbol with its source, direct dependencies both ways and test coverage."""
    one = t.placed.where(F.col("stable_id") == start)
    return {
        "symbol": one, "source": source_slice(t, one), "upstream": dependency_rows(t, start), "downstream": dependency_rows(t, start, "downstream"),
        "tests": test_coverage(t, start), "subsystem": symbol_subsystem(t, start),
    }


def file_article(t: Tables, path: str) -> dict[str, DataFrame]:
    """A file with its outline, the files it uses and is used by, and its subsystem's other files."""
    one = t.files.where(F.col("path") == path)
    ids = one.select("id")
    names = t.files.select("id", "path")
    used = t.imports.join(ids.withColumnRenamed("id", "source_file_id"), "source_file_id", "left_semi").select(F.col("target_file_id").alias("id")).join(names, "id")
    users = t.imports.join(ids.withColumnRenamed("id", "target_file_id"), "target_file_id", "left_semi").select(F.col("source_file_id").alias("id")).join(names, "id")
    near = t.files.join(one.where(F.col("subsystem_id").isNotNull()).select("subsystem_id"), "subsystem_id", "left_semi").where(F.col("path") != path)
    return {"file": one, "outline": symbols.file_outline(t).where(F.col("path") == path), "uses": used.select("path"), "used_by": users.select("path"), "subsystem": near.select("path")}


def overview(t: Tables, start: str, depth: int = 2, limit: int = 10) -> dict[str, DataFrame]:
    """Counts of a symbol, its nearest callers and callees, and the blast radius by depth."""
    nearest = lambda d: risk.dependencies(t, start, d, depth).orderBy("depth", "name", "stable_id").limit(limit)
    return {"counts": symbols.overview(t).where(F.col("stable_id") == start), "callers": nearest("upstream"), "callees": nearest("downstream"), "stats": dependency_stats(t, start, depth=depth)}


def symbol_subsystem(t: Tables, start: str) -> DataFrame:
    """(subsystem_id, files): the stored subsystem of a symbol's file."""
    f = t.placed.where(F.col("stable_id") == start).select("path").join(t.files.select("path", "subsystem_id"), "path").where(F.col("subsystem_id").isNotNull())
    return t.files.join(f.select("subsystem_id").distinct(), "subsystem_id", "left_semi").groupBy("subsystem_id").agg(F.count(F.lit(1)).alias("files"))


def subsystem_detail(t: Tables, subsystem: str) -> DataFrame:
    """(path, symbols, exported): the files of a stored subsystem."""
    n = t.symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("symbols"), F.count_if("is_exported").alias("exported"))
    return t.files.where(F.col("subsystem_id") == subsystem).join(n, "id", "left").select("path", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("exported", F.lit(0)).alias("exported"))


def subsystem_neighbours(t: Tables, subsystem: str, limit: int = 12) -> DataFrame:
    """(other_id, outgoing, incoming): imports between a stored subsystem and others, the busiest first."""
    x = structure.cross_subsystem(t)
    out = x.where(F.col("from_id") == subsystem).select(F.col("to_id").alias("other_id"), F.col("imports").alias("outgoing"), F.lit(0).cast("long").alias("incoming"))
    into = x.where(F.col("to_id") == subsystem).select(F.col("from_id").alias("other_id"), F.lit(0).cast("long").alias("outgoing"), F.col("imports").alias("incoming"))
    both = out.unionByName(into).groupBy("other_id").agg(F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming"))
    return both.orderBy(F.desc(F.col("outgoing") + F.col("incoming")), "other_id").limit(limit)


def largest_subsystem(t: Tables) -> str | None:
    row = t.files.where(F.col("subsystem_id").isNotNull()).groupBy("subsystem_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "subsystem_id").first()
    return row["subsystem_id"] if row else None


def api_trace(endpoints: DataFrame, t: Tables, pattern: str, role: str | None = None) -> DataFrame:
    """(role, path_pattern, http_method, file_path, line, name): endpoints whose pattern contains ``pattern``, any case."""
    x = endpoints.where(F.lower("path_pattern").contains(pattern.lower()))
    x = x.where(F.col("role") == role) if role else x
    names = t.symbols.select(F.col("stable_id").alias("symbol_stable_id"), "name")
    return x.join(names, "symbol_stable_id", "left").select("role", "path_pattern", "http_method", "file_path", "line", "name").orderBy("role", "path_pattern", "file_path", "line")


# ------------------------------------------------------------------ searches


def summary_hits(t: Tables, summaries: DataFrame, query: str) -> DataFrame:
    """Symbols whose summary (symbol_stable_id, summary) contains the query, any case."""
    s = summaries.where(F.lower("summary").contains(query.lower())).select(F.col("symbol_stable_id").alias("stable_id"))
    return t.placed.where(~F.col("is_test")).join(s, "stable_id", "left_semi")


def find(t: Tables, query: str, exact: bool = False, kind: str | None = None, limit: int = 20, summaries: DataFrame | None = None, include_tests: bool = False) -> DataFrame:
    """(place, stable_id, name, qualified_name, kind, path): the search box.

    Full-text hits come first, then symbols found by their summary; of one qualified name
    the first counts. Five times as many hits as asked for are taken before ``kind`` is
    applied. A query without a searchable word is looked up as an exact name.
    """
    cols = ["stable_id", "name", "qualified_name", "kind", "path"]
    words = [w for w in sanitize(query).split() if w]
    if exact or not words:
        hits = symbols.search_exact(t, query, kind, include_tests, limit).select(*cols, F.lit(0).alias("source"), F.lit(0.0).alias("order"))
    else:
        text = search.full_text(t, query, limit=5 * limit, include_tests=include_tests)
        hits = text.select("stable_id", F.col("score").alias("order")).join(t.placed, "stable_id").select(*cols, F.lit(0).alias("source"), (-F.col("order")).alias("order"))
        if summaries is not None:
            more = summary_hits(t, summaries, query).orderBy("qualified_name").limit(5 * limit)
            hits = hits.unionByName(more.select(*cols, F.lit(1).alias("source"), F.lit(0.0).alias("order")))
    if kind:
        hits = hits.where(F.col("kind") == kind)
    first = Window.partitionBy("qualified_name").orderBy("source", "order", "stable_id")
    return hits.withColumn("r", F.row_number().over(first)).where("r = 1").orderBy("source", "order", "qualified_name").limit(limit).select(F.col("source").alias("place"), *cols)


def find_everywhere(t: Tables, part: str, limit: int = 20) -> DataFrame:
    """(project, stable_id, name, kind, path): names that contain ``part``, any case, over all projects.

    Of each project the first three times ``limit`` by length and name are taken, then the
    first ``limit`` of all.
    """
    x = t.placed.where(~F.col("is_test") & F.lower("name").contains(part.lower())).withColumn("project", F.substring_index("path", "/", 1))
    order = [F.length("name"), "name", "stable_id"]
    per = x.withColumn("r", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where(F.col("r") <= 3 * limit)
    return per.orderBy(*order).limit(limit).select("project", "stable_id", "name", "kind", "path")


def merged(parts: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """Results (stable_id, distance) of several projects as one list, the nearest first."""
    out = None
    for project, df in parts.items():
        one = df.select(F.lit(project).alias("project"), "stable_id", "distance").orderBy("distance", "stable_id").limit(limit)
        out = one if out is None else out.unionByName(one)
    return out.orderBy("distance", "project", "stable_id").limit(limit)


# ------------------------------------------------------------------ federation


def project_edges(t: Tables) -> DataFrame:
    """(source_project, source_stable_id, target_project, target_stable_id, kind, confidence): edges between symbols of
    different projects, as rows of the cross-project table."""
    return t.linked.where((F.col("source_project") != F.col("target_project")) & (F.col("kind") != "contains")).select(
        "source_project", F.col("source_id").alias("source_stable_id"), "target_project", F.col("target_id").alias("target_stable_id"), "kind", "confidence"
    ).distinct()


def fan_out(t: Tables, xedges: DataFrame, project: str, start: str, depth: int = 2) -> DataFrame:
    """(project, stable_id, depth): what uses ``start`` in other projects: one hop over ``xedges``, then callers there.

    The hop's landings are depth 0; walks stay inside the project they landed in.
    """
    landed = xedges.where((F.col("target_project") == project) & (F.col("target_stable_id") == start)).select(F.col("source_project").alias("key"), F.col("source_stable_id").alias("id")).distinct()
    e = t.linked.where((F.col("source_project") == F.col("target_project")) & F.col("kind").isin(*_NO_CONTAINS)).select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    r = graph.reach(landed, e, depth)
    return r.select(F.col("key").alias("project"), F.col("id").alias("stable_id"), "depth")


def has_inbound(xedges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``ids`` (project, stable_id) that some other project refers to."""
    x = xedges.where(F.col("confidence") != "heuristic").select(F.col("target_project").alias("project"), F.col("target_stable_id").alias("stable_id"))
    return ids.join(x, ["project", "stable_id"], "left_semi")


def chains(xedges: DataFrame, project: str, start: str, goal: str, max_hops: int = 5) -> DataFrame:
    """(hops, chain): ways over project edges from a symbol into the project ``goal``; each landing once, by its
    shortest and then smallest chain of "project symbol" steps."""
    step = lambda p, s: F.concat_ws(" ", p, s)
    e = xedges.select(step("source_project", "source_stable_id").alias("src"), step("target_project", "target_stable_id").alias("dst"), "target_project").distinct()
    now = xedges.sparkSession.createDataFrame([([f"{project} {start}"],)], "chain array<string>")
    seen, out = None, None
    for hops in range(1, max_hops + 1):
        grown = now.withColumn("src", F.element_at("chain", -1)).join(e, "src").where(~F.array_contains("chain", F.col("dst")))
        best = grown.groupBy("dst", "target_project").agg(F.min(F.concat("chain", F.array("dst"))).alias("chain"))
        if seen is not None:
            best = best.join(seen, "dst", "left_anti")
        level = graph.Stored(best, "chains", counted=True)
        if not level.rows:
            break
        seen = level.read().select("dst") if seen is None else seen.unionByName(level.read().select("dst"))
        hit = level.read().where(F.col("target_project") == goal).select(F.lit(hops).alias("hops"), "chain")
        out = hit if out is None else out.unionByName(hit)
        now = level.read().select("chain")
    return out if out is not None else xedges.sparkSession.createDataFrame([], "hops int, chain array<string>")


def trace_across(t: Tables, xedges: DataFrame, project: str, start: str, goal_project: str, goal: str, max_hops: int = 5) -> DataFrame:
    """(hops, chain, path, length): one local trace to ``goal`` from each landing in its project."""
    out = None
    for row in chains(xedges, project, start, goal_project, max_hops).orderBy("hops", "chain").limit(20).collect():  # a report of the 20 nearest landings
        landing = row["chain"][-1].split(" ", 1)[1]
        found = risk.trace(t, landing, goal, max_paths=1).select(F.lit(row["hops"]).alias("hops"), F.array(*map(F.lit, row["chain"])).alias("chain"), "path", "length")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else t.spark.createDataFrame([], "hops int, chain array<string>, path array<string>, length int")


# ------------------------------------------------------------------ registry


def _start(f, callers=True, **kw):
    return risk._from_busiest(f, callers, **kw)


def _of_largest(f):
    def run(spark, d):
        t = Tables(spark, d)
        return f(t, largest_subsystem(t) or "")

    return run


def _of_symbol(f):
    """For the symbol of the least id whose file is in a subsystem."""

    def run(spark, d):
        t = Tables(spark, d)
        row = t.placed.join(t.files.where(F.col("subsystem_id").isNotNull()).select("path"), "path", "left_semi").agg(F.min("stable_id").alias("id")).first()
        return f(t, row["id"] or "")

    return run


def _detail_sources(t: Tables) -> DataFrame:
    return source_slice(t, t.placed.where("kind = 'function'").select("stable_id"))


QUERIES = {
    "graph_dependency_rows": _start(dependency_rows),
    "graph_dependency_rows_down": _start(dependency_rows, callers=False, direction="downstream"),
    "graph_dependency_stats": _start(dependency_stats),
    "graph_blast_tests": _start(blast_tests),
    "risk_test_coverage": _start(test_coverage),
    "risk_dead_code_by_file": lambda s, d: dead_by_file(Tables(s, d)),
    "symbols_sources": lambda s, d: _detail_sources(Tables(s, d)),
    "structure_subsystem_detail": _of_largest(subsystem_detail),
    "structure_subsystem_neighbours": _of_largest(subsystem_neighbours),
    "structure_symbol_subsystem": _of_symbol(symbol_subsystem),
    "federation_search": lambda s, d: find_everywhere(Tables(s, d), "token"),
    "federation_project_edges": lambda s, d: project_edges(Tables(s, d)),
    "federation_inbound": lambda s, d: has_inbound(project_edges(t := Tables(s, d)), t.placed.select(F.substring_index("path", "/", 1).alias("project"), "stable_id")),
}

_ROWS = """ SELECT s.stable_id, s.name, s.kind, s.path, x.edge_kind, 'resolved' AS confidence FROM (
  SELECT e.{other} AS id, min_by(e.kind, (list_position({kinds}, e.kind), e.id)) AS edge_kind FROM ec e JOIN {busy} b ON e.{own} = b.id WHERE e.kind <> 'contains' AND e.{other} <> b.id GROUP BY 1
) x JOIN sf s ON s.stable_id = x.id"""
_BIG = "(SELECT subsystem_id FROM fc WHERE subsystem_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, subsystem_id LIMIT 1)"
_XS = "(SELECT a.subsystem_id AS f, b.subsystem_id AS t FROM im JOIN fc a ON a.id = source_file_id JOIN fc b ON b.id = target_file_id WHERE a.subsystem_id <> b.subsystem_id)"
_PE = """SELECT DISTINCT split_part(a.path, '/', 1) AS source_project, e.source_id AS source_stable_id, split_part(b.path, '/', 1) AS target_project, e.target_id AS target_stable_id, e.kind, e.confidence
FROM ec e JOIN sf a ON a.stable_id = e.source_id JOIN sf b ON b.stable_id = e.target_id WHERE e.kind <> 'contains' AND split_part(a.path, '/', 1) <> split_part(b.path, '/', 1)"""

ORACLE = {
    "graph_dependency_rows": risk._sql(_ROWS.format(other="source_id", own="target_id", busy="busy", kinds=_NO_CONTAINS)),
    "graph_dependency_rows_down": risk._sql(_ROWS.format(other="target_id", own="source_id", busy="busy_caller", kinds=_NO_CONTAINS)),
    "graph_dependency_stats": risk._sql(risk._walk_sql(_NO_CONTAINS, True, 3) + " SELECT n.depth, count(*) AS nodes, count(DISTINCT s.path) AS files FROM near n LEFT JOIN sf s ON s.stable_id = n.id WHERE n.depth > 0 GROUP BY 1"),
    "graph_blast_tests": "SELECT path, count(*) AS tests, max(depth) AS deepest FROM (" + risk.ORACLE["graph_blast_radius"] + ") WHERE affected_test GROUP BY 1",
    "risk_test_coverage": risk._sql("SELECT f.path, CASE l.r WHEN 1 THEN 'called' ELSE 'imported' END AS confidence FROM links l JOIN busy b ON l.stable_id = b.id JOIN fc f ON f.id = l.test_file_id"),
    "risk_dead_code_by_file": risk._sql("SELECT path, count(*) AS n FROM dead GROUP BY 1"),
    "symbols_sources": with_views(
        """SELECT DISTINCT s.stable_id, array_to_string(list_slice(string_split(d.text, chr(10)), s.line_start, s.line_end), chr(10)) AS source FROM sf s JOIN documents d ON d.file_id = s.file_id
        WHERE s.kind = 'function' AND d.doc_kind = 'source_file' AND s.line_start > 0"""
    ),
    "structure_subsystem_detail": with_views(f"SELECT path, coalesce(n, 0) AS symbols, coalesce(x, 0) AS exported FROM fc LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (WHERE is_exported) AS x FROM sc GROUP BY 1) y ON y.file_id = fc.id WHERE subsystem_id = {_BIG}"),
    "structure_subsystem_neighbours": with_views(
        f"""SELECT other_id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT t AS other_id, 1 AS o, 0 AS i FROM {_XS} WHERE f = {_BIG} UNION ALL SELECT f, 0, 1 FROM {_XS} WHERE t = {_BIG})
        GROUP BY 1 ORDER BY sum(o) + sum(i) DESC, other_id LIMIT 12"""
    ),
    "structure_symbol_subsystem": risk._sql("SELECT f.subsystem_id, count(*) AS files FROM fc f WHERE f.subsystem_id = (SELECT arg_min(y.subsystem_id, s.stable_id) FROM sf s JOIN fc y ON y.path = s.path WHERE y.subsystem_id IS NOT NULL) GROUP BY 1"),
    "federation_search": with_views(
        """SELECT project, stable_id, name, kind, path FROM (SELECT *, split_part(path, '/', 1) AS project, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY length(name), name, stable_id) AS r
        FROM sf WHERE NOT is_test AND contains(lower(name), 'token')) WHERE r <= 60 ORDER BY length(name), name, stable_id LIMIT 20"""
    ),
    "federation_project_edges": with_views(_PE),
    "federation_inbound": with_views(f"SELECT DISTINCT target_project AS project, target_stable_id AS stable_id FROM ({_PE}) WHERE confidence <> 'heuristic'"),
}
